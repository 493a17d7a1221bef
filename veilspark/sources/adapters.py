"""Contracts of the decoders that turn PDF and image bytes into tables.

No decoder is bundled. One registers under a kind and yields Arrow-friendly pandas frames with the columns of the kind's
contract; a file that cannot be decoded yields a row with an error code instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

CONTRACTS = {
    "text_pages": "file string, page int, width double, height double, unit string, scanned boolean, text string, error string",
    "chars": "file string, page int, line int, pos int, ch string, x0 double, y0 double, x1 double, y1 double, error string",
    "lines": "file string, page int, line int, text string, x0 double, y0 double, x1 double, y1 double, score double, turn int, source string, error string",
    "faces": "file string, page int, id long, x0 double, y0 double, x1 double, y1 double, score double, error string",
    "signatures": "file string, page int, id long, x0 double, y0 double, x1 double, y1 double, text string, error string",
    "qr": "file string, page int, id long, x0 double, y0 double, x1 double, y1 double, text string, error string",
    "paths": "file string, page int, id long, x0 double, y0 double, x1 double, y1 double, curves int, segments int, fill boolean, visible boolean, error string",
    "metadata": "file string, location string, text string, error string",
    "fingerprints": "file string, page int, xref int, width int, height int, digest string, error string",
    "pixels": "file string, element string, value int, before int, after int, error string",
    "redacted": "file string, page int, content binary, rasterized boolean, reason string, error string",
}
Decoder = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
_DECODERS: dict[str, Decoder] = {}


class MissingAdapter(LookupError):
    """No decoder of this kind is registered."""


def register(kind: str, decoder: Decoder) -> None:
    if kind not in CONTRACTS:
        raise KeyError(f"unknown kind {kind}; known: {', '.join(CONTRACTS)}")
    _DECODERS[kind] = decoder


def missing() -> list[str]:
    return [k for k in CONTRACTS if k not in _DECODERS]


def decode(files: DataFrame, kind: str) -> DataFrame:
    """Rows of a kind for files (file, content). Equal contents are decoded once and joined back."""
    from pyspark.sql import functions as F

    if kind not in _DECODERS:
        raise MissingAdapter(kind)
    decoder, schema = _DECODERS[kind], CONTRACTS[kind]
    columns = [c.split()[0] for c in schema.split(", ")]
    def shaped(out: pd.DataFrame) -> pd.DataFrame:
        own = out.reindex(columns=columns).astype(object)
        return own.where(own.notna(), None)

    keyed = files.withColumn("digest_", F.sha2("content", 256))
    one = keyed.groupBy("digest_").agg(F.min("file").alias("file"))  # digests move, contents do not

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(len(batch)):
                frame = batch.iloc[i : i + 1].reset_index(drop=True)
                try:
                    yield from (shaped(out) for out in decoder(iter([frame])))
                except Exception as e:  # noqa: BLE001 - a broken file is a row, not a failed job
                    yield shaped(pd.DataFrame([{"file": frame["file"][0], "error": f"corrupt: {type(e).__name__}"}]))

    found = files.join(one.select("file"), "file", "left_semi").select("file", "content").mapInPandas(run, schema)
    back = keyed.select(F.col("file").alias("own_"), "digest_").join(one.select(F.col("file").alias("rep_"), "digest_"), "digest_")
    return found.join(back, F.col("file") == F.col("rep_")).withColumn("file", F.col("own_")).select(*columns)
