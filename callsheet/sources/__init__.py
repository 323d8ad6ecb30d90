"""Reading and writing tables, and turning transcripts into turns."""

from callsheet.sources.fragments import names_with_fragments
from callsheet.sources.rollups import StoredRollup, merged_states, rollup_states
from callsheet.sources.tables import (
    append_numbered,
    append_rows,
    delete_in_files,
    file_bounds,
    finish_replacing,
    literal_rows,
    read_table,
    replace_partitions,
    replace_table,
    update_partitions,
)
from callsheet.sources.transcript_source import read_transcript_source, transcript_source
from callsheet.sources.transcripts import (
    escaped,
    read_transcripts,
    speaker_words,
    to_turns,
    unescaped,
    unlisted,
)

__all__ = [
    "StoredRollup",
    "append_numbered",
    "append_rows",
    "delete_in_files",
    "escaped",
    "file_bounds",
    "finish_replacing",
    "literal_rows",
    "merged_states",
    "names_with_fragments",
    "read_table",
    "read_transcript_source",
    "read_transcripts",
    "replace_partitions",
    "replace_table",
    "rollup_states",
    "speaker_words",
    "to_turns",
    "transcript_source",
    "unescaped",
    "unlisted",
    "update_partitions",
]
