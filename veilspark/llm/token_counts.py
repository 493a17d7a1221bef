"""Token counts of whole texts without materialising ids.

Where a tokenizer's own pre-tokenizer drops white space, the pieces of a text are the pieces of its white-space-free runs,
its pre-tokens. Then

1. the distinct pre-tokens of the corpus are gathered in a table with their uses;
2. the tokenizer counts the pieces of each distinct pre-token once;
3. each document's pre-token frequencies are joined to these counts and summed. The HOT_RUNS most used pre-tokens of at most
   HOT_BYTES bytes are sent to all tasks (so what is sent is bounded whatever the corpus), which sum them in place; the
   frequencies of the others, none of which is frequent, are joined by a shuffle.

Pre-tokens are compared as strings. Whether a tokenizer is of that kind is asked of its pre-tokenizer, with a probe; of other
tokenizers (byte-level ones that keep white space, sentencepiece) whole texts are counted, in one pass.

Defined results: null and empty texts have 0 tokens; a text is never truncated; equal rows get equal counts, and rows that
repeat a key each get a row; an empty table gives an empty result; only the key and text columns are read, so other columns
can have any name.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_staged, small_batches, staged
from .textops import IS_SPACE, buffers, segments, word_bounds

HOT_RUNS = 1 << 18
HOT_BYTES = 64
BATCH = 8 << 20
_PROBE = "a b\tc\nd\x0be\x0cf\rg"


def _path(tokenizer: str) -> str:
    """Place of a tokenizer's file; a name that is no path is one that public_tokenizers knows."""
    if os.path.isabs(tokenizer):
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


def _whole(path: str):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()
    return whole


def drops_space(tokenizer: str) -> bool:
    """Whether the tokenizer's pre-tokenizer parts at each ASCII white space and keeps none of it."""
    path = _path(tokenizer)
    if path.endswith(".model"):
        return False
    own = _whole(path).pre_tokenizer
    return own is not None and [x for x, _ in own.pre_tokenize_str(_PROBE)] == list("abcdefg")


def piece_lengths(tokenizer: str) -> Callable[[list[str]], list[int]]:
    """Function from strings to their numbers of pieces."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    path = _path(tokenizer)
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    whole = _whole(path)
    return lambda texts: [len(x) for x in whole.encode_batch_fast(texts, add_special_tokens=False)]


_LENGTHS: dict[str, Callable[[list[str]], list[int]]] = {}


def _lengths(tokenizer: str) -> Callable[[list[str]], list[int]]:
    return _LENGTHS.get(tokenizer) or _LENGTHS.setdefault(tokenizer, piece_lengths(tokenizer))


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The white-space-free runs of the rows, in order, and the row offsets into them."""
    start, end, rows = word_bounds(data, offsets)
    places = np.concatenate([[0], np.cumsum(end - start)])
    bare = pa.py_buffer(data[~IS_SPACE[data]].tobytes())
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(places), bare).dictionary_encode(), rows


def _batches(column: pa.Array) -> Iterator[tuple[int, int, pa.DictionaryArray, np.ndarray]]:
    data, offsets = buffers(column)
    for a, b in segments(offsets, BATCH):
        yield a, b, *runs(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def pre_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """(run, uses) of the distinct pre-tokens of all texts."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, found, _ in _batches(batch.column(0)):
                uses = np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary))
                yield pa.RecordBatch.from_arrays([found.dictionary.cast(pa.string()), pa.array(uses.astype(np.int64))], names=["run", "uses"])

    return docs.select(text).mapInArrow(distinct, "run string, uses long").groupBy("run").agg(F.sum("uses").alias("uses"))


def piece_counts(distinct: DataFrame, tokenizer: str) -> DataFrame:
    """(run, uses, pieces): each distinct pre-token is given to the tokenizer once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(tokenizer)
        for batch in batches:
            for x in range(0, batch.num_rows, 4096):
                part = batch.slice(x, 4096)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lengths(part.column(0).to_pylist()), pa.int64())], names=["run", "uses", "pieces"])

    return distinct.mapInArrow(count, "run string, uses long, pieces long")


def token_counts(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = 2048, text: str = "text", key: str = "doc_id", hot_runs: int = HOT_RUNS) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of each row."""
    small_batches(docs.sparkSession)
    if not drops_space(tokenizer):
        return _whole_texts(docs, tokenizer, limit, text, key)
    context = docs.sparkSession.sparkContext
    counted = staged(piece_counts(staged(pre_tokens(docs, text), "pre-tokens"), tokenizer), "piece-counts")
    top = counted.where(F.octet_length("run") <= HOT_BYTES).orderBy(F.desc("uses"), "run").select("run", "pieces").limit(hot_runs).toArrow()
    shared = context.broadcast((top["run"].combine_chunks(), top["pieces"].to_numpy()))
    kind = docs.schema[key].dataType.simpleString()

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document: its size, tokens of hot runs, and number of other runs; then the others, with their numbers."""
        hot, pieces = shared.value
        for batch in batches:
            sizes = np.diff(buffers(batch.column(2))[1])
            for a, b, found, rows in _batches(batch.column(2)):
                at = pc.index_in(found.dictionary.cast(pa.string()), value_set=hot)
                known = at.is_valid().to_numpy(zero_copy_only=False)
                cost = np.zeros(len(known), np.int64)
                cost[known] = pieces[at.drop_null().to_numpy()]
                index = found.indices.to_numpy()
                sums = np.diff(np.concatenate([[0], np.cumsum(cost[index])])[rows])
                cold = np.flatnonzero(~known[index])
                row = np.searchsorted(rows, cold, side="right") - 1
                pair, n = np.unique(row * max(1, len(known)) + index[cold], return_counts=True)
                row, run = pair // max(1, len(known)), pair % max(1, len(known))
                many = np.bincount(row, minlength=b - a)
                who = np.concatenate([np.arange(a, b), row + a])
                none, zeros = pa.nulls(b - a, pa.string()), np.zeros(len(pair), np.int64)
                long = lambda x, y: pa.array(np.concatenate([x, y]).astype(np.int64))
                own = pa.concat_arrays([none, found.dictionary.cast(pa.string()).take(pa.array(run))])
                key_ = pa.concat_arrays([batch.column(1).slice(a, b - a), pa.nulls(len(pair), batch.column(1).type)])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who)), key_, long(sizes[a:b], zeros), long(sums, zeros), own, long(many, n)], names=["row", "k", "n_bytes", "tokens", "run", "n"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("k"), F.col(text).alias("t"))
    table = staged(rows.mapInArrow(frequencies, f"row long, k {kind}, n_bytes long, tokens long, run string, n long"), "frequencies")
    rest = table.where("run is not null").select("row", "run", "n").join(counted.select("run", "pieces"), "run")
    rest = rest.groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    own = table.where("run is null")
    done = own.where("n = 0").select("k", "n_bytes", "tokens")
    done = done.unionByName(own.where("n > 0").join(rest, "row").select("k", "n_bytes", (F.col("tokens") + F.col("more")).alias("tokens")))
    return done.select(F.col("k").alias(key), "n_bytes", F.col("tokens").alias("n_tokens"), (F.col("tokens") > limit).alias("over_limit"))


def _whole_texts(docs: DataFrame, tokenizer: str, limit: int, text: str, key: str) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(tokenizer)
        for batch in batches:
            n = pa.array(lengths(["" if x is None else x for x in batch.column(1).to_pylist()]), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(buffers(batch.column(1))[1])), n, pc.greater(n, limit)], names=[key, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(count, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
