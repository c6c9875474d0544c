"""Schemas of the stored relations; every reader states its schema, none is inferred."""

from __future__ import annotations

SONGS = "song string, artist string, text string"
PROCESSED = "chunk_id long, document_id long, tokens array<string>"
METADATA = "chunk_id long, document_id long, title string, artist string, text string"
CODEBOOK = "term string, rank int"
TERM_INDEX = "term string, idf_value double, postings array<struct<chunk_id:int,tf:int>>"
DOC_NORMS = "chunk_id long, norm_value double"
IMAGES = "nombre_archivo string, ruta_original string, histograma array<double>"
FASHION_IMAGES = "id long, nombre_archivo string, ruta_original string, histograma_visual array<float>"
AUDIO = (
    "audio_id long, filename string, track_number int, title string, collaborators string, album string, audio_data binary, "
    "content_type string, file_size long, duration_seconds double, created_at timestamp"
)
CENTROIDS = "word_id int, centroid array<double>"

#: Relations of the store by name.
RELATIONS = {
    "codebook": CODEBOOK, "term_index": TERM_INDEX, "metadata": METADATA, "doc_norms": DOC_NORMS, "fashion_images": FASHION_IMAGES, "audio_dataset": AUDIO,
}


def create_statements(root: str) -> list[str]:
    """Statements that create the relations as Parquet tables under a folder; existing ones stay."""
    return [f"CREATE TABLE IF NOT EXISTS {name} ({', '.join(_column(c) for c in _split(ddl))}) USING parquet LOCATION '{root}/{name}'" for name, ddl in RELATIONS.items()]


def _split(ddl: str) -> list[str]:
    """Columns of a schema string; commas inside brackets do not part columns."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[start:i].strip())
            start = i + 1
    return [*out, ddl[start:].strip()]


def _column(text: str) -> str:
    name, kind = text.split(" ", 1)
    return f"`{name}` {kind}"
