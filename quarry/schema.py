"""Tables of the archive as Spark schemas."""

from __future__ import annotations

TURNS = "session_id string, seq long, uuid string, ts string, role string, text string, is_meta int, is_sidechain int, project string, cwd string"
SESSIONS = "session_id string, file_path string, project string, cwd string, first_ts string, last_ts string, num_turns long, last_seq long, file_size long, file_mtime long, checkpointed_seq long, scan_offset long, scan_seq long, skipped_lines long, partial_tail int, ingested_at string"
TAGS = "session_id string, ns string, tag string, rank int"
FACTS = "id long, project string, name string, type string, title string, hook string, leaf_path string, description string, tags string, index_seq long, pinned int, status string, hits long, created_at string, updated_at string, last_used_at string, superseded_at string, superseded_by long, origin_session string"
QUEUE = "session_id string, enqueued_at string, enqueue_seq long"
TOMBSTONES = "session_id string, forgotten_at string"
EMBEDDINGS = "turn_id long, model string, dim int, vec array<float>"
SEEN = "session string, source string"
