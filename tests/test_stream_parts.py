from quarry.streaming.transcripts import _Reader


def test_many_short_files_are_few_tasks_and_every_byte_once():
    start, end = {"/r/p/3.jsonl": 40, "/r/p/5.jsonl": 900}, {f"/r/p/{k}.jsonl": 100 + k for k in range(3000)} | {"/r/p/big.jsonl": 5_000_000}
    tasks = _Reader("file:///r", (), 1 << 20).partitions(start, end)
    assert len(tasks) < 30
    got = {}
    for p in (p for t in tasks for p in t.parts):
        assert got.get(p.path, start.get(p.path, 0) if not p.fresh else 0) == p.start
        got[p.path] = p.stop
    assert got == end
