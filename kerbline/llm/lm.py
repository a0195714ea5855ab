"""Language-model scores: add-half unigrams, and the marginal of a subword lattice.

The lattice model draws pieces of an existing subword vocabulary independently; a word is its characters after the mark
of a word's start, and its probability is the sum over all ways to cut it into pieces, by the forward recursion in log
space. The pieces are the vocabulary's. Its scores are merge ranks and no log probabilities, so they weigh as a Zipf prior of
half a count a piece, to which the counts of the training documents, cut by the vocabulary's own segmenter, are added. A
word of the training documents is also a piece as a whole: with N tokens, T of them distinct and c occurrences of the word,
its probability is (c + T * lattice) / (N + T), after Witten and Bell, so the lattice holds the mass of new words. Pieces
never span words, so a text's log probability is the sum over its words and one end. Both scores of a word are computed
once for every distinct word of the corpus.

The ``HEAD`` most frequent words (of at most ``HEAD_BYTES`` bytes) and the ``LONG`` most frequent longer ones (of at most
``LONG_BYTES``) travel to every worker: their number is fixed, so is the size of what is broadcast. All other words are
joined to their scores.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.runtime import materialize

HEAD, HEAD_BYTES = 150_000, 64
LONG, LONG_BYTES = 100, 1 << 16
#: Distinct words that a task counts before it passes them on.
FLUSH = 200_000
START = "▁"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def held_out(doc_id: Column) -> Column:
    """Remainder 1 of crc32 of the id's text by 5; a null id is for training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def count_words(docs: DataFrame, text_col: str, held: Column) -> DataFrame:
    """``(word, c, n)``: occurrences in training documents and in all."""
    source = docs.select(F.col(text_col).alias("text"), held.alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, rest = Counter(), Counter()

        def rows() -> pa.RecordBatch:
            names = list(train.keys() | rest.keys())
            c = [train[w] for w in names]
            n = [a + rest[w] for a, w in zip(c, names)]
            train.clear()
            rest.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(c, pa.int64()), pa.array(n, pa.int64())], ["word", "c", "n"])

        for b in batches:
            for text, out in zip(b.column(0), b.column(1)):
                (rest if out.as_py() else train).update(tokens(text.as_py()))
                if len(train) + len(rest) > FLUSH:
                    yield rows()
        yield rows()

    each = source.mapInArrow(run, "word binary, c long, n long")
    return each.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


@functools.cache
def _segmenter(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def count_pieces(words: DataFrame, path: str) -> dict[int, int]:
    """How often the segmenter uses each piece in the training words; as many entries as the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, model = Counter(), _segmenter(path)
        for b in batches:
            texts = [w.decode(errors="replace") for w in b.column(0).to_pylist()]
            for ids, c in zip(model.encode(texts, num_threads=1), b.column(1).to_pylist()):
                for i in ids:
                    used[i] += c
        yield pa.RecordBatch.from_arrays([pa.array(list(used), pa.int32()), pa.array(list(used.values()), pa.int64())], ["piece", "n"])

    found = words.where("c > 0").select("word", "c").mapInArrow(run, "piece int, n long")
    return {r["piece"]: r["n"] for r in found.groupBy("piece").agg(F.sum("n").alias("n")).collect()}


class Lattice:
    """Log probabilities (natural) of words under independent pieces."""

    def __init__(self, path: str, used: dict[int, int], ends: int) -> None:
        model = _segmenter(path)
        size = model.get_piece_size()
        total = math.log(sum(used.values()) + ends + 0.5 * (size + 1))
        self.pieces: dict[str, float] = {}
        self.bytes = [0.0] * 256
        # The best piece has the greatest score; bytes have none and come last.
        rank = [size if model.is_byte(i) else max(0.0, -model.get_score(i)) for i in range(size)]
        weigh = 0.5 * size / sum(1 / (r + 2.7) for r in rank)
        for i in range(size):
            p = math.log(used.get(i, 0) + weigh / (rank[i] + 2.7)) - total
            if model.is_byte(i):
                self.bytes[int(model.id_to_piece(i)[1:-1], 16)] = p
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.pieces[model.id_to_piece(i)] = p
        self.longest = max(map(len, self.pieces))
        self.end = math.log(ends + 0.5) - total

    def word(self, word: str) -> float:
        """The forward recursion; a character that is no piece is spelled in bytes."""
        s, get = START + word, self.pieces.get
        alpha, longest, log, exp = [0.0], self.longest, math.log, math.exp
        for j in range(1, len(s) + 1):
            arcs = [a + p for i, a in enumerate(alpha[max(0, j - longest) :], max(0, j - longest)) if (p := get(s[i:j])) is not None]
            if get(s[j - 1]) is None:
                arcs.append(alpha[-1] + sum(self.bytes[b] for b in s[j - 1].encode()))
            if len(arcs) == 1:
                alpha.append(arcs[0])
            else:
                top = max(arcs)
                alpha.append(top + log(sum([exp(x - top) for x in arcs])))
        return alpha[-1]


def blend(c: np.ndarray, log_lattice: np.ndarray, n: int, v: int) -> np.ndarray:
    """Log probabilities of tokens seen ``c`` times among ``n`` of which ``v`` are distinct; the lattice's alone without training."""
    if not n:
        return log_lattice
    seen = np.log(np.maximum(c, 1e-300))
    return np.where(c > 0, np.logaddexp(seen, math.log(v) + log_lattice), math.log(v) + log_lattice) - math.log(n + v)


def score_words(words: DataFrame, lattice: Lattice, n: int, v: int) -> DataFrame:
    """``words`` with ``lattice``, the model's log10 probability of each."""
    shared = words.sparkSession.sparkContext.broadcast(lattice)  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, scale = shared.value.word, 1 / math.log(10)
        for b in batches:
            got = np.array([of(w.decode(errors="replace")) for w in b.column(0).to_pylist()], float)
            got = blend(b.column(1).to_numpy().astype(float), got, n, v) * scale
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], ["word", "c", "n", "lattice"])

    return words.select("word", "c", "n").mapInArrow(run, "word binary, c long, n long, lattice double")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, one row per row of ``docs``.

    A null text is an empty one: its end alone. A null id counts as training. Repeated rows are documents of their own.
    Other columns are not read. No rows give no rows.
    """
    spark, path = docs.sparkSession, path or default_vocabulary()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out"))
    counted = materialize(count_words(docs, "text", F.col("held_out")), "words")
    ends = docs.where("not held_out").count()
    n_words, v = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    n, v = n_words + ends, v + (ends > 0)
    lattice = Lattice(path, count_pieces(counted, path), ends)
    scored = materialize(score_words(counted, lattice, n, v), "scored")

    def base(c: Column) -> Column:
        return F.log10((c + 0.5) / (n + 0.5 * (v + 1)))

    scored = scored.withColumn("base", base(F.col("c")))
    bands = ((0, HEAD_BYTES, HEAD), (HEAD_BYTES, LONG_BYTES, LONG))
    picked = [scored.where((F.length("word") > a) & (F.length("word") <= b)).orderBy(F.desc("n"), "word").limit(k) for a, b, k in bands]
    head = picked[0].unionByName(picked[1]).select("word", "c", "base", "lattice").toArrow()
    table = (
        head.column("word").to_pylist(),
        *(np.append(head.column(k).to_numpy(), 0) for k in ("c", "base", "lattice")),
    )  # the last entry stands for every other word
    shared = spark.sparkContext.broadcast(table)
    end_base = math.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
    end_score = float(blend(np.array([float(ends)]), np.array([lattice.end]), n, v)[0]) / math.log(10)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, held_out boolean, row long, n_tokens long, n_known long, base_score double, score double, rest array<binary>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names, c, b10, l10 = shared.value
        at, other = dict(zip(names, range(len(names)))), len(names)
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            out = [[] for _ in range(6)]
            for text in b.column(1):
                found = tokens(text.as_py())
                ids = np.fromiter((at.get(w, other) for w in found), np.int64, len(found))
                rest = [found[i] for i in np.flatnonzero(ids == other)]
                sums = (len(found) + 1, int((c[ids] > 0).sum()) + (ends > 0), float(b10[ids].sum()) + end_base, float(l10[ids].sum()) + end_score)
                for k, x in enumerate((row, *sums, rest)):
                    out[k].append(x)
                row += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()))
            made = [pa.array(x, k) for x, k in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *made], schema.replace(",", "").split()[::2])

    near = materialize(docs.select("doc_id", "text", "held_out").mapInArrow(run, schema), "head-scores")
    far = near.select("row", F.explode("rest").alias("word")).groupBy("row", "word").agg(F.count("*").alias("k"))
    far = far.join(scored, "word").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(F.lit(0))).alias("more_known"),
        F.sum(F.col("k") * F.col("base")).alias("more_base"),
        F.sum(F.col("k") * F.col("lattice")).alias("more_score"),
    )
    both = near.drop("rest").join(far, "row", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return both.select(
        "doc_id", "held_out", "n_tokens", plus("n_known", "more_known"), F.lit(n).cast("long").alias("train_tokens"), plus("base_score", "more_base"), plus("score", "more_score")
    )


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 1
