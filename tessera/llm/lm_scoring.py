"""Language-model scores of whole texts: a causal attention model over subword ids, trained on the corpus, beside unigram base scores.

A text is its lower-cased words and one end. The corpus is encoded once into blocks (words as local numbers, each block's vocabulary with subword
ids), which are written to the shared folder. All statistics come from all training texts: word counts (base score), ids and their left and right
neighbours (classes of ids, P(id | class)), class bigrams. The attention model is trained by federated averaging: in each
round every block makes one pass over its share of training texts, starting from the common parameters, and the results are
averaged with the numbers of scored ids as weights. What is gathered thus grows with the number of blocks, while the driver only holds parameters and
tables bounded by the vocabulary of the tokenizer.

A word is scored where it begins: the model's classes there, renormalised over the shares of their ids that begin words, give the class of its first id, and
within the class words have their corpus frequency: P(word | context) = (1 - UNIGRAM) P(class | context, word begins) c / C(class) + UNIGRAM c / N, which sums to 1 over the
words of the training texts. A share `new` (words seen once among all, after Good and Turing) is kept for the product of a word's ids and the word's
end instead, so words never seen are scored by their ids. Word counts reach the blocks by a join on the word's 64-bit hash, one row per block and distinct word.

Rows: null and wordless texts are one end; rows with null doc_ids count as training texts; equal doc_ids are rows of their own; without any training text
all counts are 0 and the scores come from uniform tables; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import attention
from .common import LOWER, Text, documents, saved, slices, words_of
from .memory import trimming
from .tokens import encoder, release, vocabulary_path

BLOCK_BYTES = 10_000_000
#: A row group holds a few blocks, so that neither its writer nor its readers hold as many as a task has.
ROW_GROUP_BYTES = 16_000_000
#: Each round takes the texts whose number in the block has another remainder by SHARE; as many rounds as that take every text once.
ROUNDS, SHARE = 2, 2
UNIGRAM = 0.1
OWN_CLASSES, BUCKETS = 48, 16
#: Place of the counts at words' beginnings among an id's counts.
BEGINS = 2 * BUCKETS
_BLOCK = "block long, doc_ids array<long>, held_out array<boolean>, n_words binary, low binary, high binary, hashes binary, train binary, subs binary, sub_counts binary, train_tokens long"

#: What the ids of a block's texts are made of.
_TEXTS = ("held_out", "n_words", "low", "high", "subs", "sub_counts")


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Blocks of about BLOCK_BYTES of text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, count = encoder(vocabulary, 600_000), TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi, text in slices(batch.column(1), BLOCK_BYTES):
                words = words_of(text)
                by_hash = np.argsort(words.hash)
                ordered = words.hash[by_hash]
                heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
                times = np.diff(np.append(heads, len(ordered)))
                order = np.argsort(-times, kind="stable")  # frequent words get small numbers, which compress well
                rank = np.empty(len(order), np.uint32)
                rank[order] = np.arange(len(order), dtype=np.uint32)
                word = np.empty(len(ordered), np.uint32)
                word[by_hash] = np.repeat(rank, times)
                hashes, where = ordered[heads][order], by_hash[heads][order]
                del by_hash, ordered
                start, size = words.start[where], (words.end - words.start)[where]
                ends = np.cumsum(size + 1)
                # the block's distinct words, each after a blank
                spot = np.repeat(start - (ends - size), size + 1) + np.arange(int(ends[-1]) if len(ends) else 0)
                raw = LOWER[text.data[np.maximum(spot, 0)]] if len(spot) else np.zeros(0, np.uint8)
                raw[ends - size - 1] = 0x20
                subs, at = enc.encode(Text(raw, np.concatenate([[0], ends])))
                ids = batch.column(0).slice(lo, hi - lo).to_pylist()
                held = np.array([held_out(i) for i in ids], bool)
                n = np.diff(words.first)
                train = np.bincount(word[np.repeat(~held, n)], minlength=len(hashes))
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": pa.array([part << 24 | count]), "doc_ids": pa.array([ids], pa.list_(pa.int64())), "held_out": pa.array([held.tolist()], pa.list_(pa.bool_())),
                        "n_words": [n.astype("<u4").tobytes()], "low": [(word & 0xFFFF).astype("<u2").tobytes()], "high": [(word >> 16).astype("<u2").tobytes()],
                        "hashes": [hashes.astype("<u8").tobytes()], "train": [train.astype("<u4").tobytes()], "subs": [subs.astype("<u2").tobytes()],
                        "sub_counts": [np.diff(at).astype("<u4").tobytes()], "train_tokens": pa.array([int(n[~held].sum() + (~held).sum())]),
                    }
                )
                count += 1

    # the writer looks at its sizes at each row, not each hundredth: a block's row is megabytes
    return saved(docs.mapInArrow(trimming(encode), _BLOCK), "blocks", **{"parquet.block.size": str(ROW_GROUP_BYTES), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"})


class Block:
    """A block's arrays; columns that are not there are empty."""

    def __init__(self, row: dict):
        take = lambda name, kind: np.frombuffer(row.get(name, b""), kind)
        self.doc_ids, self.held_out = row.get("doc_ids", []), np.array(row["held_out"], bool)
        self.n_words = take("n_words", "<u4").astype(np.int64)
        self.word = take("low", "<u2").astype(np.int32) | take("high", "<u2").astype(np.int32) << 16
        self.hashes, self.train = take("hashes", "<u8"), take("train", "<u4")
        self.subs, self.sub_counts = take("subs", "<u2").astype(np.int32), take("sub_counts", "<u4").astype(np.int32)
        self.first = np.concatenate([[0], np.cumsum(self.n_words)])

    def texts(self, docs: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the texts, each followed by the end id; the texts' numbers of ids; and the ids of each word and end, in order."""
        n = self.n_words[docs]
        ends = np.cumsum(n)
        which = np.repeat(self.first[docs] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)
        # the end is one more word, the last
        subs, counts = np.append(self.subs, np.int32(end)), np.append(self.sub_counts, np.int32(1))
        word = np.insert(self.word[which], ends, len(counts) - 1)
        count, to_first = counts[word], (np.cumsum(counts) - counts).astype(np.int32)
        to = np.cumsum(count, dtype=np.int64)
        total = int(to[-1]) if len(to) else 0
        kind = np.int32 if total < 1 << 30 else np.int64
        ids = subs[np.repeat((to_first[word] - (to - count)).astype(kind), count) + np.arange(total, dtype=kind)]
        bounds = np.cumsum(n + 1)
        lengths = np.diff(np.concatenate([[0], to[bounds - 1]])) if len(bounds) else bounds
        return ids, lengths, count


def _row(table: pa.RecordBatch | pa.Table, row: int) -> dict:
    """A row whose binary values are not copied."""
    values = {name: table.column(name)[row] for name in table.schema.names}
    return {name: x.as_buffer() if isinstance(x, pa.BinaryScalar) else x.as_py() for name, x in values.items()}


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    release()
    for batch in batches:
        for row in range(batch.num_rows):
            yield Block(_row(batch, row))


def _parts(docs: np.ndarray, n: np.ndarray, words: int = 200_000) -> Iterator[np.ndarray]:
    """Runs of texts of about so many words."""
    group = np.cumsum(n[docs] + 1) // words
    return (x for x in np.split(docs, np.flatnonzero(np.diff(group)) + 1) if len(x)) if len(docs) else iter(())


def id_counts(blocks: DataFrame, end: int) -> DataFrame:
    """(id, bucket, n) over all training texts: how often an id follows (bucket below BUCKETS) or precedes (above) an id of the bucket; the bucket BEGINS: how often it begins a word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = BEGINS + 1
        for block in _blocks(batches):
            table = np.zeros((end + 1) * size, np.int64)
            for docs in _parts(np.flatnonzero(~block.held_out), block.n_words):
                ids, lengths, count = block.texts(docs, end)
                last = np.concatenate([[end], ids[:-1]])
                table += np.bincount(np.concatenate([ids * size + last * 7 % BUCKETS, last * size + BUCKETS + ids * 7 % BUCKETS]), minlength=len(table))
                table += np.bincount(ids[np.cumsum(count) - count] * size + BEGINS, minlength=len(table))
            some = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array((some // size).astype(np.int32)), pa.array((some % size).astype(np.int32)), pa.array(table[some])], ["id", "bucket", "n"])

    return blocks.select(*_TEXTS).mapInArrow(trimming(count), "id int, bucket int, n long").groupBy("id", "bucket").agg(F.sum("n").alias("n"))


def classes(counts: np.ndarray, number: int = attention.CLASSES, steps: int = 8) -> np.ndarray:
    """A class for each id: frequent ids have one of their own, the end (the last id) has one, all others are clustered by their neighbours' buckets."""
    total = counts.sum(axis=1)
    order = np.argsort(-total[:-1], kind="stable")
    out = np.zeros(len(total), np.int64)
    own, rest = order[:OWN_CLASSES], order[OWN_CLASSES:]
    out[own] = np.arange(len(own))
    out[-1] = number - 1
    free = number - 1 - len(own)
    x = np.sqrt(counts / np.maximum(1, total)[:, None]).astype(np.float32)[rest]
    centres = x[:free].copy()
    for _ in range(steps):
        near = np.argmin((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1)
        weight = np.bincount(near, total[rest], len(centres))
        sums = np.stack([np.bincount(near, total[rest] * x[:, k], len(centres)) for k in range(x.shape[1])], axis=1)
        used = weight > 0
        centres[used] = sums[used] / weight[used, None]
    unseen = total[rest] == 0
    near[unseen] = np.arange(int(unseen.sum())) % len(centres)
    out[rest] = len(own) + near
    return out


def bigram_counts(blocks: DataFrame, kinds, end: int, number: int) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            table = np.zeros(number * number, np.int64)
            for docs in _parts(np.flatnonzero(~block.held_out), block.n_words):
                kind = kinds.value[block.texts(docs, end)[0]]
                table += np.bincount(np.concatenate([[number - 1], kind[:-1]]) * number + kind, minlength=len(table))
            some = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(table[some])], ["pair", "n"])

    return blocks.select(*_TEXTS).mapInArrow(trimming(count), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _inputs(ids: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """What each id of the texts follows; a text's first id follows an end."""
    last = np.concatenate([[end], ids[:-1]])
    last[(np.cumsum(lengths) - lengths)[lengths > 0]] = end
    return last


def trained(blocks: DataFrame, kinds, end: int, p: dict[str, np.ndarray], rounds: int = ROUNDS, share: int = SHARE) -> dict[str, np.ndarray]:
    """Federated averaging."""
    context = blocks.sparkSession.sparkContext
    for turn in range(rounds):
        common = context.broadcast(p)

        def fit(batches: Iterator[pa.RecordBatch], turn: int = turn, common=common) -> Iterator[pa.RecordBatch]:
            for block in _blocks(batches):
                docs = np.flatnonzero(~block.held_out)
                docs = docs[turn % share :: share] if len(docs) > turn % share else docs[:1]
                ids, lengths, _ = block.texts(docs, end)
                if not len(ids):
                    continue
                new, _ = attention.trained(common.value, kinds.value[_inputs(ids, lengths, end)], kinds.value[ids], lengths, rate=0.01 / (turn + 1), seed=turn)
                v = attention.vector(new).astype(np.float64) * len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v), pa.array(np.full(len(v), float(len(ids))))], ["place", "value", "weight"])

        sums = blocks.select(*_TEXTS).mapInArrow(trimming(fit), "place int, value double, weight double").groupBy("place").agg((F.sum("value") / F.sum("weight")).alias("v"))
        rows = sums.orderBy("place").collect()  # as many as the model has parameters
        common.unpersist()
        if rows:
            p = attention.from_vector(np.array([r["v"] for r in rows]), p)
    return p


class Vocabulary(NamedTuple):
    """Per id: its class, log P(id | class), log P(id | class, word begins). Per class: the share of its ids that begin words, and how often one does."""

    kind: np.ndarray
    within: np.ndarray
    begins: np.ndarray
    share: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, number: int) -> Vocabulary:
        kind, total, heads = classes(counts[:, :BEGINS], number), counts[:, :BUCKETS].sum(axis=1), counts[:, BEGINS]
        part = lambda n: np.log((n + 0.1) / np.bincount(kind, n + 0.1, number)[kind])
        times = np.bincount(kind, heads, number)
        share = np.where(times > 0, times / np.maximum(1, np.bincount(kind, total, number)), 1e-9)  # hardly any for classes that never began a word
        return cls(kind, part(total), part(heads), share, times)


def word_logs(p: dict[str, np.ndarray], v: Vocabulary, ids: np.ndarray, lengths: np.ndarray, count: np.ndarray, c: np.ndarray, train_tokens: int, unigram: float, new: float) -> np.ndarray:
    """Natural log P(word | the words before it in its text) of each word and end. count: its number of ids; c: its count in the training texts."""
    end = len(v.kind) - 1
    logs, begins = attention.scores(p, v.kind[_inputs(ids, lengths, end)], v.kind[ids], lengths, v.share)
    head = np.cumsum(count) - count
    first, kind = ids[head], v.kind[ids[head]]
    start = logs[head] + np.log(v.share[kind]) - begins[head]  # log P(class of its first id | a word begins)
    seen = np.log(np.maximum(c, 1e-300))
    known = np.logaddexp(np.log1p(-unigram) + start + seen - np.log(np.maximum(v.times[kind], 1)), np.log(max(unigram, 1e-300)) + seen - np.log(max(1, train_tokens)))
    rest = logs + v.within[ids]
    rest[head] = 0
    after = np.append(begins[head[1:]], 0)
    after[first == end] = 0  # nothing follows a text's end
    spelled = start + v.begins[first] + np.add.reduceat(rest, head) + after
    return np.logaddexp(np.log1p(-new) + known, np.log(new) + spelled)


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


_RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def scored(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, unigram: float = UNIGRAM, rounds: int = ROUNDS, share: int = SHARE) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark, vocabulary = docs.sparkSession, vocabulary or vocabulary_path()
    context, number = spark.sparkContext, attention.CLASSES
    end = encoder(vocabulary).tokenizer.get_vocab_size(True)
    release()
    if end >= 1 << 16:
        raise ValueError("blocks hold ids of 16 bits")
    blocks = encoded(documents(docs, id_col, text_col), vocabulary)
    facts = blocks.agg(F.sum("train_tokens").alias("n"), F.sum(F.expr("size(filter(held_out, x -> not x))")).alias("docs")).first()
    train_tokens, ends = facts["n"] or 0, facts["docs"] or 0

    counts = np.zeros((end + 1, BEGINS + 1), np.int64)
    table = id_counts(blocks, end).toArrow()  # at most ids x buckets rows
    counts[table["id"].to_numpy(), table["bucket"].to_numpy()] = table["n"].to_numpy()
    vocabulary_facts = Vocabulary.of(counts, number)
    kinds = context.broadcast(vocabulary_facts.kind)
    pairs = np.full(number * number, 0.05)
    table = bigram_counts(blocks, kinds, end, number).toArrow()
    pairs[table["pair"].to_numpy()] += table["n"].to_numpy()
    pairs = pairs.reshape(number, number)
    p = trained(blocks, kinds, end, attention.initial(np.log(pairs / pairs.sum(axis=1, keepdims=True))), rounds, share)
    model, facts_of = context.broadcast(p), context.broadcast(vocabulary_facts)

    def vocabulary_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, hashes, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                hashes, times = np.frombuffer(hashes, "<i8"), np.frombuffer(times, "<u4").astype(np.int32)
                for lo in range(0, len(hashes), 100_000):
                    some = slice(lo, lo + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[some]), pa.array(np.full(len(hashes[some]), block)), pa.array(times[some])], ["hash", "block", "times"])

    rows = blocks.select("block", "hashes", "train").mapInArrow(vocabulary_rows, "hash long, block long, times int")
    whole = Window.partitionBy("hash")  # a row per block that has the word
    placed = rows.select("block", "hash", F.sum("times").over(whole).alias("c"), (F.col("block") == F.min("block").over(whole)).alias("first"))
    placed = saved(placed, "counts")
    found = placed.where("first").agg(F.count_if(F.col("c") > 0).alias("distinct"), F.count_if(F.col("c") == 1).alias("once")).first()
    distinct = found["distinct"] + (1 if ends else 0)
    new = min(0.5, max(1e-6, found["once"] / max(1, train_tokens)))
    number_of_blocks = blocks.select("block").count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), number_of_blocks // 4)  # a few blocks a task, however many there are

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        release()
        hashes, times = right.column("hash").to_numpy(), right.column("c").to_numpy()
        order = np.argsort(hashes)
        hashes, times, out = hashes[order], times[order], []
        for row in range(left.num_rows):
            block = Block(_row(left, row))
            own = block.hashes.astype("<u8").view(np.int64)
            c = times[np.searchsorted(hashes, own)] if len(own) else np.zeros(0, np.int64)
            c = np.append(c, ends)  # the last is the end's count
            base = np.log10(c + 1.0) - np.log10(train_tokens + distinct + 1.0)
            for docs in _parts(np.arange(len(block.doc_ids)), block.n_words):
                ids, lengths, count = block.texts(docs, end)
                word = np.insert(block.word[block.first[docs[0]] : block.first[docs[-1] + 1]], np.cumsum(block.n_words[docs]), len(c) - 1)
                mixed = word_logs(model.value, facts_of.value, ids, lengths, count, c[word], train_tokens, unigram, new)
                heads = np.cumsum(block.n_words[docs] + 1) - block.n_words[docs] - 1
                sums = lambda x: np.add.reduceat(x, heads)  # noqa: B023, E731
                out.append(pa.RecordBatch.from_arrays(
                    [
                        pa.array([block.doc_ids[d] for d in docs.tolist()], pa.int64()), pa.array(block.held_out[docs]), pa.array(block.n_words[docs] + 1), pa.array(sums((c[word] > 0).astype(np.int64))),
                        pa.array(np.full(len(docs), train_tokens)), pa.array(sums(base[word])), pa.array(sums(mixed) / np.log(10)),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                ))
        return pa.Table.from_batches(out, _RESULT)

    dealt = lambda df: df.repartition(parts, "block").groupBy("block")
    return dealt(blocks.select("block", "doc_ids", "hashes", *_TEXTS)).cogroup(dealt(placed.select("block", "hash", "c"))).applyInArrow(score, _SCORED)
