"""The most similar vectors of every vector: additive quantisation with exact reranking.

Vectors are normalised and written as a sum of full-dimensional codewords, one of each residual codebook, found by beam
search. The first codebook (two for very many vectors) also names the cell; every vector is looked for in the cells of its
best first words. Within a cell, scores come from lookup tables (query times codeword) and stored norms; the best are
compared exactly. How many cells are searched and how many scores compared is set for each file by the true neighbours of
some of its vectors, so that a growing file with more cells loses no larger share.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.runtime import cut

#: Parameters of the index. The sample that codebooks are fitted on is bounded per file; every vector is indexed.
CELLS, CELL_ROWS, MOST_CELLS = 2, 1024, 4096
LEVELS, WORDS, BEAM, RERANK = 4, 256, 3, 24
SAMPLE_ROWS, MOST_SAMPLE = 8192, 65536
#: All files together: the sample on the driver stays within this many vectors, however many files there are.
MOST_TOTAL = 262_144
BLOCK_ROWS = 16384
CHUNK = 512
#: Calibration: vectors of a file compared with all others, the share of their neighbours that may be lost, and the least pairs to go by.
ASKED, LOSS, LEAST_PAIRS = 512, 0.005, 100


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    half = 0.5 * (words * words).sum(1)
    return np.concatenate([np.argmax(part @ words.T - half, 1) for part in np.array_split(x, max(1, len(x) // 4096))])


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    words = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = _nearest(x, words)
        order = np.argsort(near, kind="stable")
        held, starts = np.unique(near[order], return_index=True)
        words[held] = np.add.reduceat(x[order], starts, axis=0) / np.diff(np.append(starts, len(x)))[:, None]
    return words


class Quantiser:
    """Residual codebooks over the full dimension; the first ``coarse`` of them name the cell."""

    def __init__(self, books: list[np.ndarray], coarse: int):
        self.books, self.coarse = books, coarse
        self.cells = math.prod(len(b) for b in books[:coarse])
        self.probes, self.width = CELLS, RERANK
        self.cell_load: dict[int, float] = {}
        self.rows = 0

    @classmethod
    def fit(cls, x: np.ndarray, rows: int, seed: int = 7) -> Quantiser:
        """``x``: a sample of normalised vectors of the ``rows`` there are."""
        rng = np.random.default_rng(seed)
        cells = max(1, 2 ** math.ceil(math.log2(max(1, rows * CELLS / CELL_ROWS))))
        sizes = [min(cells, MOST_CELLS)] + ([cells // MOST_CELLS] if cells > MOST_CELLS else [])
        books, rest = [], x
        for k in [*sizes, *[WORDS] * LEVELS]:
            words = _kmeans(rest, k, rng).astype(np.float32)
            rest = rest - words[_nearest(rest, words)]
            books.append(words)
        return cls(books, len(sizes))

    def calibrate(self, asked: np.ndarray, near: np.ndarray, x: np.ndarray, rows: int) -> None:
        """Sets ``probes`` and ``width`` so that of the pairs (asked, near) hardly any is lost. ``x``: the sample that stands for ``rows``."""
        pairs, factor = len(asked), rows / len(x)
        self.rows = rows
        most = min(self.cells, MOST_CELLS)  # pairs that share none of these count as sharing the last cell only
        if pairs:
            need = np.full(pairs, self.cells)
            for i in range(0, pairs, 128):
                for j, (a, b) in enumerate(zip(self._names(asked[i : i + 128], most), self._names(near[i : i + 128], most))):
                    _, at, to = np.intersect1d(a, b, assume_unique=True, return_indices=True)
                    if len(at):
                        need[i + j] = np.maximum(at, to).min() + 1
            self.probes = max(CELLS, int(np.quantile(need, 1 - LOSS, method="higher")))
        named, codes, norms = self.encode(x)
        if pairs:
            _, own, own_norms = self.encode(near)
            before = np.zeros(pairs)
            for i in range(0, pairs, 128):
                q = asked[i : i + 128]
                best = sum((q * words[own[i : i + 128, m]]).sum(1) for m, words in enumerate(self.books)) / own_norms[i : i + 128]
                score = sum((q @ words.T)[:, codes[:, m]] for m, words in enumerate(self.books)) / norms
                before[i : i + 128] = (score > best[:, None]).sum(1) * factor
            self.width = RERANK + int(np.quantile(before, 1 - LOSS, method="higher"))
        ids, counts = np.unique(named[named >= 0], return_counts=True)
        self.cell_load = {int(c): n / len(x) for c, n in zip(ids, counts)}

    def blocks(self) -> dict[int, int]:
        """The number of blocks of every cell that is expected to hold more than ``BLOCK_ROWS`` vectors."""
        return {c: math.ceil(share * self.rows / BLOCK_ROWS) for c, share in self.cell_load.items() if share * self.rows > BLOCK_ROWS}

    def _names(self, x: np.ndarray, most: int) -> np.ndarray:
        """The numbers of the ``most`` best cells, best first."""
        if self.coarse == 1:
            words = self.books[0]
            return np.argsort(0.5 * (words * words).sum(1) - x @ words.T, axis=1, kind="stable")[:, :most]
        return np.concatenate([self._encode(p, most)[0] for p in np.array_split(x, max(1, len(x) * most // 4096))])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells (n x probes; -1: none), codes (n x books) and norms of the decoded vectors, by beam search."""
        parts = [self._encode(p, self.probes) for p in np.array_split(x, max(1, len(x) * max(BEAM, self.probes) // 4096))]
        return tuple(np.concatenate(p) for p in zip(*parts))

    def _encode(self, x: np.ndarray, probes: int):
        n = len(x)
        rest, codes, error = x[:, None, :], np.zeros((n, 1, 0), np.int32), np.zeros((n, 1), np.float32)
        cells = np.full((n, probes), -1, np.int64)
        for level, words in enumerate(self.books):
            beam = rest.shape[1]
            grown = error[:, :, None] - 2 * (rest.reshape(n * beam, -1) @ words.T).reshape(n, beam, -1) + (words * words).sum(1)
            grown = grown.reshape(n, -1)
            keep = min(max(BEAM, probes) if level < self.coarse else BEAM, grown.shape[1])
            best = np.argpartition(grown, keep - 1, axis=1)[:, :keep]
            error = np.take_along_axis(grown, best, 1)
            order = np.argsort(error, axis=1, kind="stable")
            best, error = np.take_along_axis(best, order, 1), np.take_along_axis(error, order, 1)
            parent, word = best // len(words), best % len(words)
            rest = np.take_along_axis(rest, parent[:, :, None], 1) - words[word]
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None].astype(np.int32)], 2)
            if level == self.coarse - 1:
                width = min(probes, codes.shape[1])
                number = reduce(lambda a, i: a * len(self.books[i]) + codes[:, :width, i], range(level + 1), np.zeros((n, width), np.int64))
                cells[:, :width] = number
                rest, codes, error = rest[:, :BEAM], codes[:, :BEAM], error[:, :BEAM]
        decoded = x - rest[:, 0]
        return cells, codes[:, 0], np.maximum(np.sqrt((decoded * decoded).sum(1)), 1e-6).astype(np.float32)

    def search(self, queries: np.ndarray, members: np.ndarray, codes: np.ndarray, norms: np.ndarray, same: bool, k: int):
        """Per query the indices and cosines of its ``k`` best members (index -1: none). ``same``: the queries are the members."""
        n = len(members)
        # where many must be compared exactly, scoring all of them exactly costs no more than the tables
        tables = self.width * 8 < n
        width = min((self.width if tables else RERANK) + same, n)
        chunk = max(16, CHUNK * RERANK // width) if tables else CHUNK
        columns = [np.unique(codes[:, m], return_inverse=True) for m in range(len(self.books))] if tables else []
        out_i, out_s = np.full((len(queries), k), -1, np.int64), np.full((len(queries), k), -2.0)
        for a in range(0, len(queries), chunk):
            q = queries[a : a + chunk]
            if tables:
                score = np.zeros((len(q), n), np.float32)
                for words, (used, column) in zip(self.books, columns):
                    score += (q @ words[used].T)[:, column]
                score /= norms
            else:
                score = q @ members.T
            if same:
                score[np.arange(len(q)), np.arange(a, a + len(q))] = np.inf
            near = np.argpartition(-score, width - 1, axis=1)[:, :width] if width < n else np.broadcast_to(np.arange(n), (len(q), n))
            exact = np.einsum("qd,qrd->qr", q.astype(np.float64), members[near].astype(np.float64))
            if same:
                exact[near == np.arange(a, a + len(q))[:, None]] = -2.0
            order = np.argsort(-exact, axis=1, kind="stable")[:, :k]
            w = order.shape[1]
            out_i[a : a + len(q), :w] = np.take_along_axis(near, order, 1)
            out_s[a : a + len(q), :w] = np.take_along_axis(exact, order, 1)
        return out_i, out_s


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    wide = x.astype(np.float64)
    wide /= np.abs(wide).max(1, keepdims=True)
    return (wide / np.sqrt((wide * wide).sum(1, keepdims=True))).astype(np.float32)


def usable(vectors: DataFrame, files: DataFrame, key: str, file: str, vec: str, size: str) -> DataFrame:
    """(key, file, vec, dim) of the vectors that take part: as long as their file says, finite, and not all zero."""
    sizes = files.where(F.col(file).isNotNull() & (F.col(size) > 0)).groupBy(F.col(file).alias("file")).agg(F.max(size).alias("dim"))
    rows = vectors.select(F.col(key).alias("id"), F.col(file).alias("file"), F.col(vec).cast("array<float>").alias("vec")).where("id is not null and vec is not null")
    sound = (F.size("vec") == F.col("dim")) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    return rows.join(F.broadcast(sizes), "file").where(sound).select("id", "file", "vec", "dim")


def _true_pairs(rows: DataFrame, asked: dict, k: int, least: float) -> pa.Table:
    """(file, n, bits): the ``k`` nearest vectors of the n-th asked one among all of its file, copies of it left out."""
    shared = rows.sparkSession.sparkContext.broadcast(asked)
    kind = rows.schema["file"].dataType.simpleString()
    file_type = rows.limit(0).select("file").toArrow().schema.field(0).type

    def look(batches):
        best: dict = {}
        for batch in batches:
            files_ = batch.column("file").to_numpy()
            for f in np.unique(files_):
                queries = shared.value.get(f.item())
                if queries is None:
                    continue
                part = batch.filter(pa.array(files_ == f))
                x = _unit(_matrix(part.column("vec"), part.column("dim")[0].as_py()))
                score = queries @ x.T
                score[score > 1 - 1e-6] = -2
                score[score < least] = -2
                width = min(k, len(x))
                at = np.argpartition(-score, width - 1, axis=1)[:, :width]
                top, vec = np.take_along_axis(score, at, 1), x[at]
                if f.item() in best:
                    top, vec = np.concatenate([best[f.item()][0], top], 1), np.concatenate([best[f.item()][1], vec], 1)
                    at = np.argsort(-top, axis=1, kind="stable")[:, :k]
                    top, vec = np.take_along_axis(top, at, 1), np.take_along_axis(vec, at[:, :, None], 1)
                best[f.item()] = top, vec
        for f, (top, vec) in best.items():
            n, j = np.nonzero(top > -2)
            if len(n):
                arrays = [pa.array([f] * len(n), file_type), pa.array(n.astype(np.int32)), pa.array(top[n, j].astype(np.float64)), pa.array([v.tobytes() for v in vec[n, j]], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["file", "n", "cosine", "bits"])

    found = rows.select("file", "dim", "vec").mapInArrow(look, f"file {kind}, n int, cosine double, bits binary")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("file", "n").orderBy(F.desc("cosine"), "bits")))
    return ranked.where(F.col("rank") <= k).select("file", "n", "bits").toArrow()


def fit_quantisers(rows: DataFrame, k: int = 5, least: float = -1.0) -> dict:
    """One quantiser per file, fitted on at most 65,536 of its vectors, drawn by a hash of the id, and calibrated by the
    ``k`` nearest (with a cosine of at least ``least``) of 512 of them among all vectors of the file."""
    counts = {r["file"]: r["n"] for r in rows.groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    wanted = {f: min(MOST_SAMPLE, max(SAMPLE_ROWS, 16 * min(MOST_CELLS, int(2 * n * CELLS / CELL_ROWS)))) for f, n in counts.items()}
    share = min(1.0, MOST_TOTAL / sum(min(wanted[f], n) for f, n in counts.items()))
    wanted = {f: max(1, int(w * share)) for f, w in wanted.items()}
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    limit = F.create_map(*[F.lit(x) for f, n in counts.items() for x in (f, int(min(1.0, wanted[f] / n) * (1 << 20)) + 1)])
    sample = rows.where(draw < F.element_at(limit, F.col("file"))).select("file", "dim", "vec").toArrow()
    made, samples, asked = {}, {}, {}
    for f in sorted(counts):
        part = sample.filter(pa.compute.equal(sample["file"], f))
        if part.num_rows:
            samples[f] = _unit(_matrix(part["vec"], part["dim"][0].as_py()))[: wanted[f]]
            made[f] = Quantiser.fit(samples[f], counts[f])
            if made[f].cells > 1 or counts[f] > RERANK:
                asked[f] = samples[f][np.random.default_rng(11).permutation(len(samples[f]))[:ASKED]]
    pairs = _true_pairs(rows, asked, k, least) if asked else None
    for f, q in made.items():
        one = other = samples[f][:0]
        if f in asked:
            part = pairs.filter(pa.compute.equal(pairs["file"], f))
            one = asked[f][part["n"].to_numpy()]
            other = np.frombuffer(b"".join(part["bits"].to_pylist()), np.float32).reshape(len(one), -1) if len(one) else one
            if len(one) < LEAST_PAIRS and least > 0:  # near pairs are rare: such at the least cosine stand in
                aside = np.random.default_rng(13).normal(size=asked[f].shape)
                aside -= (aside * asked[f]).sum(1, keepdims=True) * asked[f]
                aside = _unit(aside) if aside.any(1).all() else asked[f]
                one, other = np.concatenate([one, asked[f]]), np.concatenate([other, _unit(least * asked[f] + math.sqrt(max(0.0, 1 - least * least)) * aside)])
        q.calibrate(one, other, samples[f], counts[f])
    return made


def _copies(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors of one direction: (id, rep) of all that have copies, and (rep, heads), the six smallest ids of each class."""

    def run(batches):
        for batch in batches:
            ids, files, bits = [], [], []
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                unit = _unit(_matrix(part.column("vec"), int(dim)))
                ids.append(part.column("id").combine_chunks() if isinstance(part.column("id"), pa.ChunkedArray) else part.column("id"))
                files.append(part.column("file"))
                bits += [u.tobytes() for u in unit]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.concat_arrays(files), pa.array(bits, pa.binary())], ["id", "file", "bits"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", "file"))
    hashed = rows.mapInArrow(run, f"{kinds}, bits binary").select("id", "file", F.xxhash64("bits").alias("h"), F.hash("bits").alias("g"))
    classes = hashed.groupBy("file", "h", "g").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut(hashed.join(classes, ["file", "h", "g"]).select("id", "rep", "file"))
    ranked = members.withColumn("rank", F.row_number().over(Window.partitionBy("file", "rep").orderBy("id"))).where("rank <= 6")
    return members, ranked.groupBy("file", "rep").agg(F.array_sort(F.collect_list("id")).alias("heads"))


def most_similar(vectors: DataFrame, files: DataFrame, key: str, file: str, vec: str, size: str, k: int = 5, least: float = -1.0) -> DataFrame:
    """The ``k`` (at most 5) most similar vectors of the same file for every vector that fits its file's size.

    Columns: ``file``, ``id``, ``neighbour``, ``cosine``. Only neighbours with a cosine of at least ``least`` are given.
    Approximate in which cells are searched (calibrated on some vectors of each file to lose about 1 % of these neighbours), exact in the cosines.

    Vectors that are null, empty, all zero, not finite, hold nulls or have another length than their file's ``size`` take no part, nor do
    ones without key or file; of equal cosines the smaller key comes first. Exact copies are searched once and are each
    other's nearest; no list of all pairs of copies is made. Empty tables give no rows; other columns are ignored.
    """
    rows = usable(vectors, files, key, file, vec, size)
    types = {c: rows.schema[c].dataType.simpleString() for c in ("id", "file")}
    fitted = fit_quantisers(rows, k, least)
    blocks = {(f, c): n for f, q in fitted.items() for c, n in q.blocks().items()}
    models = rows.sparkSession.sparkContext.broadcast((fitted, blocks))

    def route(batches):
        fitted, blocks = models.value
        for batch in batches:
            files_ = batch.column("file").to_numpy()
            for f in np.unique(files_):
                part = batch.filter(pa.array(files_ == f))
                q = fitted[f.item()]
                x = _unit(_matrix(part.column("vec"), part.column("dim")[0].as_py()))
                ids = part.column("id").to_numpy()
                bits = [u.tobytes() for u in x]
                # copies within the batch travel once, under their smallest id
                first: dict[bytes, int] = {}
                for i, b in enumerate(bits):
                    j = first.setdefault(b, i)
                    if ids[i] < ids[j]:
                        first[b] = i
                at = np.fromiter(first.values(), np.int64)
                cells, codes, norms = q.encode(x[at])
                packed = [np.append(c, n.view(np.int32)).astype("<i4").tobytes() for c, n in zip(codes, norms)]
                out: list[tuple] = []
                for r, i in enumerate(at):
                    for c in cells[r]:
                        if c < 0:
                            continue
                        nb = blocks.get((f.item(), int(c)), 1)
                        own = int(np.frombuffer(bits[i], np.uint32).sum() % nb)
                        for other in range(nb):
                            out.append((int(c), min(own, other), max(own, other), own, r))
                cell, lo, hi, own, r = (np.array(c, np.int64) for c in zip(*out))
                arrays = [pa.array(np.full(len(r), f)), pa.array(cell), pa.array(lo), pa.array(hi), pa.array(own), pa.array(ids[at][r]), pa.array([bits[at[i]] for i in r], pa.binary()), pa.array([packed[i] for i in r], pa.binary())]
                yield pa.RecordBatch.from_arrays([a.cast(t) for a, t in zip(arrays, kinds)], names)

    names = ["file", "cell", "lo", "hi", "own", "id", "bits", "codes"]
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "smallint": pa.int16(), "string": pa.string()}
    kinds = [arrow[types["file"]], pa.int64(), pa.int32(), pa.int32(), pa.int32(), arrow[types["id"]], pa.binary(), pa.binary()]
    routed = rows.mapInArrow(route, f"file {types['file']}, cell bigint, lo int, hi int, own int, id {types['id']}, bits binary, codes binary")

    def within(table: pa.Table) -> pa.Table:
        fitted, _ = models.value
        f = table["file"][0].as_py()
        q = fitted[f]
        ids, bits, own = table["id"].to_numpy(), table["bits"].to_pylist(), table["own"].to_numpy()
        first: dict[bytes, int] = {}
        for i, b in enumerate(bits):
            j = first.setdefault(b, i)
            if ids[i] < ids[j]:
                first[b] = i
        at = np.sort(np.fromiter(first.values(), np.int64))
        ids, own = ids[at], own[at]
        x = np.frombuffer(b"".join([bits[i] for i in at]), np.float32).reshape(len(at), -1)
        packed = table["codes"].to_pylist()
        codes = np.frombuffer(b"".join([packed[i] for i in at]), "<i4").reshape(len(at), -1)
        codes, norms = codes[:, :-1], codes[:, -1].copy().view(np.float32)
        lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
        found = []
        for a, b in ((lo, hi),) if lo == hi else ((lo, hi), (hi, lo)):
            me, they = np.flatnonzero(own == a), np.flatnonzero(own == b)
            if len(me) and len(they):
                i, s = q.search(x[me], x[they], codes[they], norms[they], a == b, k)
                good = (i >= 0) & (s >= least) & (s > -2)
                found.append((np.repeat(ids[me], k).reshape(i.shape)[good], ids[they][i[good]], s[good]))
        a, b, s = (np.concatenate(c) if c else np.zeros(0) for c in (zip(*found) if found else ([], [], [])))
        return pa.table({"file": pa.array([f] * len(a), kinds[0]), "id": pa.array(a, kinds[5]), "neighbour": pa.array(b, kinds[5]), "cosine": pa.array(s, pa.float64())})

    edges = routed.groupBy("file", "cell", "lo", "hi").applyInArrow(within, f"file {types['file']}, id {types['id']}, neighbour {types['id']}, cosine double")
    members, heads = _copies(rows)
    # each class of copies stands for its first members, itself included
    own = members.select("file", F.col("rep").alias("id")).distinct().select("file", "id", F.col("id").alias("neighbour"), F.lit(1.0).alias("cosine"))
    reached = edges.unionByName(own).join(heads.withColumnRenamed("rep", "neighbour"), ["file", "neighbour"], "left")
    spread = reached.select("file", "id", F.explode(F.coalesce("heads", F.array("neighbour"))).alias("neighbour"), "cosine")
    listed = cut(spread.groupBy("file", "id").agg(F.array_sort(F.collect_set(F.struct((-F.col("cosine")).alias("minus"), "neighbour"))).alias("near")))
    # copies take the list of the first of their class; they are on the left, where adaptive execution splits a class that holds many rows
    copied = members.withColumnRenamed("id", "member").join(listed.withColumnRenamed("id", "rep"), ["file", "rep"]).select("file", F.col("member").alias("id"), "near")
    everyone = copied.unionByName(listed.join(members.select("file", F.col("rep").alias("id")).distinct(), ["file", "id"], "left_anti").select("file", "id", "near"))
    others = F.slice(_first_of_each(F.filter("near", lambda x: x["neighbour"] != F.col("id"))), 1, k)
    return everyone.select("file", "id", F.explode(others).alias("x")).select("file", "id", "x.neighbour", (-F.col("x.minus")).alias("cosine")).where(F.col("cosine") >= least)


def _first_of_each(near):
    """Of the rows about one neighbour (found in two cells, or with a last digit's difference) the first stays."""
    return F.filter(near, lambda x, i: F.array_position(F.transform(near, lambda y: y["neighbour"]), x["neighbour"]) == i + 1)
