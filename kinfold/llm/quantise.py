"""Operator 6: embedding near-duplicates by product quantisation.

Equal vectors of a label form one class. Coarse centres cut the space into
inverted lists; a vector's residual from its centre is stored as one code for
each subspace, with the length of what the code leaves out. A query visits every
list whose cell comes within the link radius of it (the distance to the plane
between two centres bounds that from below). In a list, asymmetric distances are
sums of table entries; by the triangle inequality a vector whose table distance
exceeds radius plus its own coding error cannot link. What is left is ranked by
exact cosine in double precision. So probing and codes only save work: no link
is lost, whatever sample the centres were fitted on.

Lists with many residents or visitors are dealt over cells. A cell gives counts
for each class and a spanning forest of its links, never the pairs.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null label, link with nothing and are their own
component; vectors of different lengths never link; repeated rows are vectors of
their own; rows without vec_id link with nothing and are not kept; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.vectors import kmeans, matrix, packed, squared, units
from kinfold.operators.components import connected_components
from kinfold.operators.storage import scoped, written

#: Documented bound of the sample that centres and codes are fitted on.
SAMPLE = 10_000
SUBSPACES, CODES = 8, 256
#: A list is laid out for so many vectors of all labels; least and most lists.
LIST_SIZE, LEAST_LISTS, MOST_LISTS = 1024, 16, 1024
RESIDENTS, QUERIES, BLOCK = 4096, 16384, 128
SEED = 3


class Codec:
    """Coarse centres and the residuals' subspace codebooks of one dimension."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int, codes: int) -> None:
        random = np.random.default_rng(SEED)
        self.centres = kmeans(sample, lists, 8, random)
        rest = sample - self.centres[squared(sample, self.centres).argmin(1)]
        self.cuts = np.linspace(0, sample.shape[1], min(subspaces, sample.shape[1]) + 1).astype(int)
        self.books = [kmeans(np.ascontiguousarray(rest[:, a:b]), codes, 6, random) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]
        gaps = np.sqrt(squared(self.centres, self.centres))
        self.gaps = np.where(gaps > 0, gaps, np.inf)

    def home(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's list, and its squared distances to all centres."""
        far = squared(rows, self.centres)
        return far.argmin(1), far

    def encode(self, rows: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals, and the length of what they leave out."""
        rest = rows - self.centres[home]
        code, left = np.empty((len(rows), len(self.books)), dtype=np.uint8), np.zeros(len(rows))
        for m, book in enumerate(self.books):
            part = rest[:, self.cuts[m] : self.cuts[m + 1]]
            code[:, m] = squared(part, book).argmin(1)
            left += ((part - book[code[:, m]]) ** 2).sum(1)
        return code, np.sqrt(left)

    def probes(self, home: np.ndarray, far: np.ndarray, radius: float) -> list[np.ndarray]:
        """For each row the later lists that may hold something in the radius."""
        bound = (far - far[np.arange(len(far)), home][:, None]) / (2 * self.gaps[home])
        near = (bound <= radius + 1e-6) & (np.arange(far.shape[1]) > home[:, None])
        return [np.flatnonzero(x) for x in near]

    def tables(self, queries: np.ndarray, number: int) -> list[np.ndarray]:
        """For each subspace, squared distances of queries to its code words."""
        rest = queries - self.centres[number]
        return [squared(rest[:, self.cuts[m] : self.cuts[m + 1]], book) for m, book in enumerate(self.books)]


def forest(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row or column, root) positions that connect what ``link`` connects;
    columns are numbered after the rows, roots are rows."""
    n, m = link.shape
    row, column = np.arange(n), np.full(m, n)
    while True:
        new_column = np.minimum(column, np.where(link, row[:, None], n).min(0))
        new_row = np.minimum(row, np.where(link, new_column, n).min(1))
        if (new_row == row).all() and (new_column == column).all():
            break
        row, column = new_row, new_column
    root = np.concatenate([row, column])
    at = np.flatnonzero((root < n) & (root != np.arange(n + m)))
    return at, root[at]


def _fit(classes: DataFrame, lists: int, subspaces: int, codes: int, sample: int) -> dict[int, Codec]:
    some = classes.orderBy(F.xxhash64("digest"), "digest").limit(sample).select("vec").collect()
    by_size: dict[int, list] = {}
    for r in some:
        by_size.setdefault(len(r.vec) // 8, []).append(bytes(r.vec))
    return {d: Codec(units(np.frombuffer(b"".join(v), "<f8").reshape(len(v), d)), lists, subspaces, codes) for d, v in by_size.items()}


def links(classes: DataFrame, threshold: float, codecs: dict[int, Codec]) -> DataFrame:
    """Rows (src, dst, n): n links between src and copies of other vectors, and
    forest edges src-dst with n = 0. ``classes`` has label, rep, n, vec."""
    radius = math.sqrt(max(0.0, 2 - 2 * threshold))
    shared = classes.sparkSession.sparkContext.broadcast(codecs)

    def deal(batches):
        for batch in batches:
            size = np.array([len(v.as_py()) // 8 for v in batch.column("vec")])
            for d in np.unique(size):
                rows = batch.take(pa.array(np.flatnonzero(size == d)))
                if int(d) not in shared.value:  # a length that the sample missed: one list without codes
                    visits = [np.empty(0, int)] * rows.num_rows
                    home, code, left = np.zeros(rows.num_rows, int), None, np.zeros(rows.num_rows)
                else:
                    codec = shared.value[int(d)]
                    unit = units(matrix(rows.column("vec")))
                    home, far = codec.home(unit)
                    visits = codec.probes(home, far, radius)
                    code, left = codec.encode(unit, home)
                times = np.array([1 + len(v) for v in visits])
                at = np.repeat(np.arange(rows.num_rows), times)
                list_no = np.concatenate([np.concatenate([[h], v]) for h, v in zip(home, visits, strict=True)]).astype(np.int32)
                resident = np.zeros(len(at), dtype=bool)
                resident[np.cumsum(times) - times] = True
                names = ["label", "size", "list", "resident", "rep", "n", "vec", "code", "rest"]
                for lo in range(0, len(at), 2048):
                    some = at[lo : lo + 2048]
                    picked = rows.take(pa.array(some))
                    own = resident[lo : lo + 2048]
                    codes = [code[i].tobytes() if code is not None and r else b"" for i, r in zip(some, own, strict=True)]
                    yield pa.RecordBatch.from_arrays([picked.column("label"), pa.array(np.full(len(some), d, np.int32)), pa.array(list_no[lo : lo + 2048]), pa.array(own), picked.column("rep"), picked.column("n"), picked.column("vec"), pa.array(codes, pa.binary()), pa.array(left[some])], names=names)

    dealt = classes.select("label", "rep", "n", "vec").mapInArrow(deal, "label string, size int, list int, resident boolean, rep long, n long, vec binary, code binary, rest double")
    dealt = written(dealt, "lists")
    key = ["label", "size", "list"]
    sizes = dealt.groupBy(*key).agg(F.ceil(F.sum(F.col("resident").cast("int")) / RESIDENTS).cast("int").alias("p_n"), F.ceil(F.count("*") / QUERIES).cast("int").alias("s_n")).where("p_n > 0")
    # residents stand in one part for every salt; queries (residents too) go to every part under one salt
    joined = dealt.join(sizes, key)
    index = joined.where("resident").withColumn("p", F.pmod(F.xxhash64("rep"), "p_n")).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("s_n") - 1))).withColumn("asks", F.lit(False))
    asking = joined.withColumn("s", F.pmod(F.xxhash64("rep", F.lit(1)), "s_n")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("p_n") - 1))).withColumn("asks", F.lit(True))
    cols = [*key, "resident", "rep", "n", "vec", "code", "rest", "asks", F.col("p").cast("int").alias("p"), F.col("s").cast("int").alias("s")]
    cells = index.select(*cols).unionByName(asking.select(*cols))

    def meet(cell: pa.Table) -> pa.Table:
        out = [_cell(cell.filter(pa.compute.invert(cell.column("asks"))), cell.filter(cell.column("asks")), shared.value, threshold, radius)]
        src, dst, n = (np.concatenate([o[i] for o in out]) for i in range(3))
        return pa.table({"src": src, "dst": dst, "n": n})

    return cells.groupBy(*key, "p", "s").applyInArrow(meet, "src long, dst long, n long")


def _cell(index: pa.Table, asking: pa.Table, codecs: dict[int, Codec], threshold: float, radius: float):
    size, number = asking.column("size")[0].as_py(), asking.column("list")[0].as_py()
    x, rep_x, n_x = units(matrix(index.column("vec"))), index.column("rep").to_numpy(), index.column("n").to_numpy()
    q, rep_q, n_q = units(matrix(asking.column("vec"))), asking.column("rep").to_numpy(), asking.column("n").to_numpy()
    at_home, reach = asking.column("resident").to_numpy(), radius + index.column("rest").to_numpy() + 1e-6
    codec = codecs.get(size)
    code = np.frombuffer(b"".join(index.column("code").to_pylist()), np.uint8).reshape(len(x), -1) if codec else None
    counts_x, counts_q = np.zeros(len(x), np.int64), np.zeros(len(q), np.int64)
    src, dst = [], []
    for lo in range(0, len(q), BLOCK):
        part = slice(lo, lo + BLOCK)
        if codec:
            far = sum(t[:, code[:, m]] for m, t in enumerate(codec.tables(q[part], number)))
            a, b = np.nonzero(np.sqrt(far) <= reach)
        else:
            a, b = (c.ravel() for c in np.indices((len(q[part]), len(x))))
        keep = rep_q[part][a] != rep_x[b]
        a, b = a[keep], b[keep]
        good = np.concatenate([np.einsum("ij,ij->i", q[part][a[i : i + 65536]], x[b[i : i + 65536]]) >= threshold for i in range(0, len(a), 65536)]) if len(a) else np.empty(0, bool)
        a, b = a[good], b[good]
        if not len(a):
            continue
        np.add.at(counts_q, lo + a, n_x[b])
        away = ~at_home[part][a]  # a resident's own query counts the other direction
        np.add.at(counts_x, b[away], n_q[part][a[away]])
        link = np.zeros((len(q[part]), len(x)), dtype=bool)
        link[a, b] = True
        node, root = forest(link)
        name = np.concatenate([rep_q[part], rep_x])
        src.append(name[node])
        dst.append(name[root])
    found = [(rep_x[counts_x > 0], counts_x[counts_x > 0]), (rep_q[counts_q > 0], counts_q[counts_q > 0])]
    edges = sum(map(len, src))
    who, n = (np.concatenate([f[i] for f in found]) for i in range(2))
    none = [np.empty(0, np.int64)]
    return np.concatenate([who, *src, *none]), np.concatenate([who, *dst, *none]), np.concatenate([n, np.zeros(edges, np.int64)])


@scoped
def near_vectors(df: DataFrame, threshold: float = 0.98, lists: int | None = None, subspaces: int = SUBSPACES, codes: int = CODES, sample: int = SAMPLE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept (vec_id = component_id).

    Without ``lists`` their number follows the number of different vectors.
    """
    rows = written(packed(df, id_col, vec_col, F.col(label_col)), "vectors")
    usable = F.col("vec").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    classes = written(rows.where(usable).groupBy("label", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec")), "classes")
    lists = lists or min(MOST_LISTS, max(LEAST_LISTS, classes.count() // LIST_SIZE))
    found = written(links(classes, threshold, _fit(classes, lists, subspaces, codes, sample)), "links")
    counts = found.where("n > 0").groupBy(F.col("src").alias("rep")).agg(F.sum("n").alias("others"))
    parts = connected_components(found.where("n = 0").select("src", "dst")).withColumnRenamed("node", "rep")
    known = classes.select("label", "digest", "rep", "n").join(counts, "rep", "left").join(parts, "rep", "left")
    known = known.select("label", "digest", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("part"))
    part = rows.where(usable).select("vec_id", "label", "digest").join(known, ["label", "digest"]).select("vec_id", "links", "part")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("part"))
    return part.unionByName(alone).select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("part").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("part"), F.lit(False)).alias("kept"))
