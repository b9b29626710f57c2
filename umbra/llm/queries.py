"""The queries of this subpackage, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from . import audio, bpe, chunks, language, mixing, neighbours, secrets, simhash, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.op1,
    "op2_simhash": simhash.op2,
    "op3_secrets": secrets.op3,
    "op4_substring_dedup": chunks.op4,
    "op5_bpe": bpe.op5,
    "op6_language": language.op6,
    "op7_mixing": mixing.op7,
    "op8_audio": audio.op8,
    "op9_warc": warc.op9,
    "op10_neighbours": neighbours.op10,
}

ORACLE_SQL = {"op7_mixing": mixing.OP7_SQL, "op9_warc": warc.OP9_SQL}
