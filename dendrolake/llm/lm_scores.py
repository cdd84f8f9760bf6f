"""Language-model scores of whole documents: corpus counts by shuffle, a recurrent model trained where the data lies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import HashIndex, hash_words, mix, saved, slices, split_words

#: Bytes of text of a chunk: its documents are scored together with a slice of the counts for its own words.
CHUNK_BYTES = 3_000_000
#: Training tokens of a share, about: the documents of a share are learned from one after another, by hash.
SHARE_TOKENS = 2_400_000
#: Tokens that are laid out in streams together, and least updates that a layout is to give.
BLOCK_TOKENS, UPDATES = 600_000, 36
#: Rounds of training: each learns from its part of the shares, then the shares' models are averaged.
ROUNDS = 3
#: Outputs for words beyond the most frequent: one for each hash of a word's last three characters.
ENDINGS = 1023
#: Words at most whose counts every task has: the most frequent ones, which most chunks would have to ask for.
KNOWN = 1 << 17
#: Parts that a task's model is cut into for averaging, models that are averaged together (again and again until one is
#: left), and tasks at most that learn side by side (beyond them a task takes more shares).
PARTS, TOGETHER, MOST_TASKS = 16, 64, 20_000
#: Bits of a chunk's number within its task.
_NUMBER = 40


def _word_hashes(words: pa.Array) -> np.ndarray:
    """54 bits of a word's hash and 10 bits of its ending's."""
    ends = pc.utf8_slice_codeunits(words, -3, None).dictionary_encode()
    kind = (hash_words(ends.dictionary, 3) % np.uint64(ENDINGS))[ends.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64)
    return ((hash_words(words) & ~np.uint64(1023)) | kind).view(np.int64)


def _chunks(docs: DataFrame, id_col: str, text_col: str, held: Column) -> DataFrame:
    """A row for each chunk: documents' ids, keys and folds, their words as places in the chunk's word list, and for each
    word of the list its hash and how often it comes in training documents. A chunk's number is its task's (above) and
    its place in the task, so that no two chunks have one."""
    text = F.col(text_col).cast("string")
    key = F.xxhash64(F.col(id_col).cast("string"), F.coalesce(text, F.lit("")))
    source = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(held, F.lit(False)).alias("held"), key.alias("key"))
    id_type = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << _NUMBER
        for whole in batches:
            for batch in slices(whole, "text", CHUNK_BYTES):
                words, first = split_words(batch.column("text"), lower=True)
                index = words.indices.to_numpy(zero_copy_only=False).astype(np.int32)
                hashes = _word_hashes(words.dictionary)
                out = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
                counts = np.bincount(index[np.repeat(~out, np.diff(first))], minlength=len(hashes)).astype(np.int32)
                lists = [batch.column("id"), batch.column("key"), pa.array(out), pa.array(first[1:])]
                arrays = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
                flat = [pa.array([x.tobytes()], pa.binary()) for x in (index, hashes, counts)]
                yield pa.RecordBatch.from_arrays([pa.array([number]), *arrays, *flat], names=["chunk", "ids", "keys", "held", "ends", "words", "hashes", "counts"])
                number += 1

    schema = f"chunk long, ids array<{id_type}>, keys array<long>, held array<boolean>, ends array<long>, words binary, hashes binary, counts binary"
    return saved(source.mapInArrow(run, schema), "chunks")


def _array(batch: pa.RecordBatch | pa.Table, name: str, i: int, kind: type) -> np.ndarray:
    return np.frombuffer(batch.column(name)[i].as_buffer(), kind)


def _counts(chunks: DataFrame) -> DataFrame:
    """``h, c``: how often each word comes in training documents. A task sends a row for each of its words, summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0

        def summed():
            h, c = (np.concatenate(x) for x in zip(*kept))
            order = np.argsort(h)
            h, c = h[order], c[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            return pa.RecordBatch.from_arrays([pa.array(h[first]), pa.array(np.add.reduceat(c, first))], names=["h", "n"])

        for batch in batches:
            for i in range(batch.num_rows):
                h, n = _array(batch, "hashes", i, np.int64), _array(batch, "counts", i, np.int32)
                kept.append((h[n > 0], n[n > 0].astype(np.int64)))
                size += len(kept[-1][0])
                if size > 1_000_000:
                    yield summed()
                    kept, size = [], 0
        if size:
            yield summed()

    rows = chunks.select("hashes", "counts").mapInArrow(run, "h long, n long")
    return saved(rows.groupBy("h").agg(F.sum("n").alias("c")), "counts")


def _most_frequent(counts: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the words of highest count, by count, then hash: all from a count on, at most KNOWN, or the
    ``least`` first ones if that gives fewer."""
    step = F.floor(F.log2("c") * 16).cast("int")
    steps = counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()  # some hundred rows
    total, low = 0, None
    for r in sorted(steps, key=lambda r: -r.s):
        total += r.n
        if total > KNOWN:
            break
        low = r.s
    if low is None or sum(r.n for r in steps if r.s >= low) < min(least, sum(r.n for r in steps)):
        found = counts.orderBy(F.desc("c"), "h").limit(least)
    else:
        found = counts.where(step >= low)
    found = found.select("h", "c").toPandas()
    h, c = found["h"].to_numpy(np.int64), found["c"].to_numpy(np.int64)
    order = np.lexsort((h, -c))
    return h[order], c[order]


def score_documents(
    docs: DataFrame,
    held: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int = ROUNDS,
    share_tokens: int = SHARE_TOKENS,
) -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    Tokens are the words of the lower-cased (A-Z) text and one end. Counts come from all rows where ``held`` is
    false, and the recurrent model learns from all their tokens once. Training documents are dealt by a hash of id
    and text to shares of about ``share_tokens``, and stand in hash order there, so that the model and the scores
    follow from the rows alone, however the input is cut into files and tasks; each share's model goes on from the
    common one, and the shares' models are averaged by their numbers of tokens, ``rounds`` times. The network has
    outputs for the most frequent words and for the endings of all others; a rarer word has the probability of its
    ending times its share of that ending's counts, so the corpus counts reach every token. ``score`` is the log10
    probability of the whole text, its state carried from window to window; ``base_score`` that of smoothed counts
    alone.

    A null or empty text is the end alone; a null ``held`` is false. Null ids are ids like others. Repeated rows each
    get their row. Without training rows all counts are zero. An empty table gives no rows. Other columns, of
    whatever name, are not used.
    """
    spark = docs.sparkSession
    chunks = _chunks(docs, id_col, text_col, held)
    counts = _counts(chunks)
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    trained = chunks.select(F.explode("held").alias("x")).where("not x").count()
    n_all, n_types = (sums.n or 0) + trained, (sums.v or 0) + (trained > 0)  # with the ends

    size = gru.CLASSES * gru.PER_CLASS
    end, rare = size - 1, size - 1 - ENDINGS
    # bounded lists: words whose counts all tasks have, and words and endings that the network has outputs for
    h, c = _most_frequent(counts, rare)
    top_hash, top_count = h[:rare], c[:rare]
    by_ending = counts.groupBy(F.col("h").bitwiseAND(F.lit(1023)).alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    rare_n, rare_v = np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64)
    for r in by_ending:
        rare_n[r.k], rare_v[r.k] = r.n, r.v
    np.subtract.at(rare_n, top_hash & 1023, top_count)
    np.subtract.at(rare_v, top_hash & 1023, 1)
    unigram = np.full(size, 0.01)
    unigram[: len(top_hash)] += top_count
    unigram[rare:end] += rare_n + 0.5
    unigram[end] += trained
    outputs = spark.sparkContext.broadcast(HashIndex(top_hash, 10))
    frequent = spark.sparkContext.broadcast((HashIndex(h, 10), c))

    def network_ids(hashes: np.ndarray) -> np.ndarray:
        ids = (rare + (hashes & 1023)).astype(np.uint16)
        where, place = outputs.value.find(hashes)
        ids[where] = place
        return ids

    def known_counts(hashes: np.ndarray) -> np.ndarray:
        """Counts of the words whose counts all tasks have, -1 for others."""
        index, count = frequent.value
        found = np.full(len(hashes), -1, np.int64)
        where, place = index.find(hashes)
        found[where] = count[place]
        return found

    def with_ends(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.insert(ids, ends, end), ends + np.arange(1, len(ends) + 1)

    params = gru.initial(np.log(unigram / unigram.sum()), classes=gru.CLASSES, per_class=gru.PER_CLASS)
    shapes = {k: v.shape for k, v in params.items()}

    def flat(p: gru.Params) -> np.ndarray:
        return np.concatenate([p[k].ravel() for k in shapes]).astype(np.float64)

    def shaped(x: np.ndarray) -> gru.Params:
        out, at = {}, 0
        for k, s in shapes.items():
            out[k] = x[at : at + int(np.prod(s))].reshape(s).astype(np.float32)
            at += int(np.prod(s))
        return out

    n_shares = max(rounds, -(-n_all // share_tokens))
    for k in range(rounds):

        def spell(batches: Iterator[pa.RecordBatch], k: int = k) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    key = batch.column("keys")[i].values.to_numpy()
                    share = (mix(key.view(np.uint64)) % np.uint64(n_shares)).astype(np.int64)
                    mine = (share % rounds == k) & ~batch.column("held")[i].values.to_numpy(zero_copy_only=False).astype(bool)
                    if not mine.any():
                        continue
                    sizes = np.diff(batch.column("ends")[i].values.to_numpy(), prepend=0)
                    words = _array(batch, "words", i, np.int32)[np.repeat(mine, sizes)]
                    ids = network_ids(_array(batch, "hashes", i, np.int64))[words]
                    held_ids, ends = with_ends(ids, np.cumsum(sizes[mine]))
                    bounds = np.concatenate([[0], ends]) * 2
                    spelled = pa.Array.from_buffers(pa.binary(), int(mine.sum()), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(held_ids.tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(share[mine]), pa.array(key[mine]), spelled], names=["share", "key", "ids"])

        common = spark.sparkContext.broadcast(params)  # about a megabyte, whatever the corpus

        def train(batches: Iterator[pa.RecordBatch], common=common) -> Iterator[pa.RecordBatch]:
            total, tokens = None, 0
            trainer, share, waiting, n = None, None, [], 0

            def learn() -> None:
                ids = np.concatenate(waiting).astype(np.int64)
                waiting.clear()
                trainer.learn(ids, int(np.clip(len(ids) // (gru.STEPS * UPDATES), 16, gru.STREAMS)))

            def close() -> None:
                nonlocal total, tokens
                if trainer is not None:
                    if waiting:
                        learn()
                    x = flat(trainer.p) * n
                    total = x if total is None else total + x
                    tokens += n

            for batch in batches:
                shares = batch.column("share").to_pylist()
                for i in range(batch.num_rows):
                    if shares[i] != share:
                        close()
                        trainer, share, n = gru.Trainer(common.value, end), shares[i], 0
                    waiting.append(_array(batch, "ids", i, np.uint16))
                    n += len(waiting[-1])
                    if n % BLOCK_TOKENS < len(waiting[-1]):  # another block is full
                        learn()
            close()
            if tokens:
                task = TaskContext.get().partitionId()
                for part, x in enumerate(np.array_split(total / tokens, PARTS)):
                    yield pa.RecordBatch.from_arrays([pa.array([task]), pa.array([part]), pa.array([float(tokens)]), pa.array([x.tobytes()])], names=["task", "part", "tokens", "x"])

        def add(pdf):
            pdf = pdf.sort_values("task")
            tokens = pdf["tokens"].sum()
            total = np.sum([np.frombuffer(x) * n for x, n in zip(pdf["x"], pdf["tokens"])], axis=0) / tokens
            return type(pdf)({"task": pdf["task"].iloc[:1] // TOGETHER, "part": pdf["part"].iloc[:1], "tokens": [tokens], "x": [total.tobytes()]})

        rows = chunks.select("keys", "held", "ends", "words", "hashes").mapInArrow(spell, "share long, key long, ids binary")
        tasks = min(MOST_TASKS, max(2, -(-2 * n_shares // rounds)))
        kind = "task long, part long, tokens double, x binary"
        models = rows.repartition(tasks, "share").sortWithinPartitions("share", "key").mapInArrow(train, kind)
        while tasks > 1:  # a group holds a part of TOGETHER models at most, whatever the corpus
            models = models.groupBy("part", F.expr(f"task div {TOGETHER}")).applyInPandas(add, kind)
            tasks = -(-tasks // TOGETHER)
        mean = models.collect()
        if mean:
            params = shaped(np.concatenate([np.frombuffer(r.x) for r in sorted(mean, key=lambda r: r.part)]))

    # the counts of each chunk's own words, but for those that all tasks have, and for words that only it has
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                h, n = _array(batch, "hashes", i, np.int64), _array(batch, "counts", i, np.int32)
                place = np.flatnonzero(known_counts(h) < 0)
                for at in range(0, len(place), 50_000):
                    own = place[at : at + 50_000]
                    chunk = pa.array(np.full(len(own), batch.column("chunk")[i].as_py()))
                    yield pa.RecordBatch.from_arrays([pa.array(h[own]), chunk, pa.array(own.astype(np.int32)), pa.array(n[own])], names=["h", "chunk", "at", "n"])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                h = _array(batch, "hashes", i, np.int64)
                own, c = network_ids(h), known_counts(h)
                c = np.where(c < 0, _array(batch, "counts", i, np.int32), c)
                more = [pa.array([x.tobytes()], pa.binary()) for x in (c, own)]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns[:-2], *more], names=[*batch.schema.names[:-2], "c", "own"])

    spread = chunks.select("chunk", "hashes", "counts").mapInArrow(entries, "h long, chunk long, at int, n int")
    found = spread.join(counts.hint("merge"), "h").where("c <> n").select("chunk", "at", "c")
    model = spark.sparkContext.broadcast(params)
    id_type = chunks.schema["ids"].dataType.elementType.simpleString()
    log_rare = np.log10(rare_n + rare_v + 1)

    def score(chunk: pa.Table, counted: pa.Table) -> pa.Table:
        if chunk.num_rows != 1:
            raise ValueError(f"{chunk.num_rows} chunks of one number")
        words, own = _array(chunk, "words", 0, np.int32), _array(chunk, "own", 0, np.uint16).astype(np.int64)
        c = _array(chunk, "c", 0, np.int64).copy()
        c[counted.column("at").to_numpy()] = counted.column("c").to_numpy()
        known = own < rare
        ends = chunk.column("ends")[0].values.to_numpy()
        n_docs, n_words = len(ends), np.diff(ends, prepend=0)
        owner = np.repeat(np.arange(n_docs, dtype=np.int32), n_words)
        total = lambda x: np.bincount(owner, x[words], minlength=n_docs)
        log_c = np.log10(c + 1)
        ids, bounds = with_ends(own[words], ends)
        log_p = gru.score_documents(model.value, ids, bounds, end) / np.log(10)
        log_p += total(np.where(known, 0.0, log_c - log_rare[np.where(known, 0, own - rare)]))
        base = total(log_c) + np.log10(trained + 1) - (n_words + 1) * np.log10(n_all + n_types + 1)
        n_known = total((c > 0).astype(np.float64)).astype(np.int64) + (trained > 0)
        pa.default_memory_pool().release_unused()
        columns = [chunk.column("ids")[0].values, chunk.column("held")[0].values, n_words + 1, n_known, np.full(n_docs, n_all, np.int64), base, log_p]
        return pa.table([pa.array(x) if isinstance(x, np.ndarray) else x for x in columns], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kept = chunks.select("chunk", "ids", "held", "ends", "words", "counts", "hashes")
    shaped_chunks = kept.mapInArrow(named, f"chunk long, ids array<{id_type}>, held array<boolean>, ends array<long>, words binary, c binary, own binary")
    # a chunk that needs no other's counts must have its group as well: cogrouping keeps it
    both = shaped_chunks.groupBy("chunk").cogroup(found.groupBy("chunk"))
    schema = f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return both.applyInArrow(score, schema).withColumnRenamed("id", id_col)
