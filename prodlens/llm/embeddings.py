"""Near-duplicate vectors by NN-descent.

Equal vectors of a label are one class. The classes' neighbour graph starts from sorted hash
codes of random projections and is refined in rounds: around every class its neighbours and
those that have it as a neighbour are compared with each other, and each class keeps its best.
Rounds end when few lists change.

Edges of at least the threshold, checked in double precision, connect the components. A list
full of such edges is saturated: there may be more, also to classes of other components. Saturated
classes are gathered in balls, and all balls of different components that can hold a link by their
angles are compared class by class. Then every component is compared with itself in tiles of
blocks, so links inside a component are complete.

An audit compares a bounded set of classes with all others of their label; if components miss
links, lists are doubled, new projections are added and the rounds go on. If they still miss links
after the last try, balls are built of all classes and not only of saturated ones, which is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prodlens.llm.components import connected_components
from prodlens.llm.storage import Stages
from prodlens.llm.text import map_batches

THRESHOLD = 0.98
NEIGHBOURS = 6
TABLES = 8
ADJACENT = 3
MOST_ROUNDS = 6
LEAST_CHANGE = 0.002
AUDIT_CLASSES = 400
AUDIT_RECALL = 0.99
MOST_TRIES = 3
BLOCK = 512
BALLS = 2048
# the lists' cosines are of single precision
SLACK = 1e-4


def _prepare(batch: pa.RecordBatch) -> pa.RecordBatch:
    groups, classes, vectors = [], [], []
    for label, v in zip(batch.column("label").to_pylist(), batch.column("embedding").to_pylist()):
        v = None if label is None or not v or None in v else np.array(v, np.float64)
        if v is None or not np.isfinite(v).all() or not np.abs(v).max() > 0:
            groups.append(None)
            classes.append(None)
            vectors.append(None)
            continue
        raw, key = (v + 0.0).tobytes(), f"{label}/{len(v)}".encode()
        groups.append(xxhash.xxh64_intdigest(key) - 2**63)
        classes.append(xxhash.xxh64_intdigest(key + b"/" + raw) - 2**63)
        vectors.append(raw)
    return pa.RecordBatch.from_arrays(
        [batch.column("vec_id"), pa.array(groups, pa.int64()), pa.array(classes, pa.int64()), pa.array(vectors, pa.binary())],
        names=["vec_id", "grp", "cls", "vec"],
    )


def _unit(raw: bytes, kind=np.float64) -> np.ndarray:
    v = np.frombuffer(raw, np.float64)
    v = v / np.abs(v).max()  # no overflow in the norm
    return (v / np.sqrt(v @ v)).astype(kind)


def _codes(bits: int, first: int):
    """Each class under TABLES hashes: sign bits of random projections, and one projection to order them by."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, drawn = [], {}
        for group, cls, raw in zip(*(batch.column(c).to_pylist() for c in ("grp", "cls", "vec"))):
            u = _unit(raw, np.float32)
            if len(u) not in drawn:
                drawn[len(u)] = np.random.default_rng((len(u), first)).standard_normal((TABLES, bits + 1, len(u))).astype(np.float32)
            p = drawn[len(u)] @ u
            code = ((p[:, :bits] > 0) << np.arange(bits)).sum(axis=1)
            out += [(group, t, int(code[t]), float(p[t, bits]), cls, u.tobytes()) for t in range(TABLES)]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["grp", "tab", "code", "place", "cls", "u"])

    return work


def _edges(a: list, b: list, cos: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(cos, pa.float64())], names=["a", "b", "cos"])


def _adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each class with the next ones of its group in the order of a hash table."""
    last: list[tuple] = []
    key = None
    for batch in batches:
        a, b, cos = [], [], []
        for group, tab, cls, raw in zip(*(batch.column(c).to_pylist() for c in ("grp", "tab", "cls", "u"))):
            if (group, tab) != key:
                key, last = (group, tab), []
            u = np.frombuffer(raw, np.float32)
            for other, v in last:
                a.append(other)
                b.append(cls)
                cos.append(float(u @ v))
            last = [*last[-ADJACENT + 1 :], (cls, u)]
        yield _edges(a, b, cos)


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs around each centre that improve a list; rows sorted by centre."""
    centre, rows = None, []

    def compare(a, b, cos):
        ids, low = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
        m = np.frombuffer(b"".join(r[1] for r in rows), np.float32).reshape(len(rows), -1)
        s = m @ m.T
        i, j = np.nonzero(np.triu(s > np.minimum(low[:, None], low[None, :]), 1))
        a += ids[i].tolist()
        b += ids[j].tolist()
        cos += s[i, j].astype(float).tolist()

    for batch in batches:
        a, b, cos = [], [], []
        for c, member, u, low in zip(*(batch.column(x).to_pylist() for x in ("centre", "member", "u", "low"))):
            if c != centre:
                if len(rows) > 1:
                    compare(a, b, cos)
                centre, rows = c, []
            rows.append((member, u, low))
        yield _edges(a, b, cos)
    if len(rows) > 1:
        a, b, cos = [], [], []
        compare(a, b, cos)
        yield _edges(a, b, cos)


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k best neighbours of every class: u, v, cos."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"), "cos").union(edges.select(F.col("b"), F.col("a"), "cos"))
    both = both.where("u <> v").groupBy("u", "v").agg(F.max("cos").alias("cos"))
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.col("cos").desc(), "v"))
    return both.withColumn("nth", place).where(F.col("nth") <= k)


def _refine(lists: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    bound = lists.groupBy("u").agg(F.when(F.count("*") >= k, F.min("cos")).otherwise(F.lit(-2.0)).alias("low"))
    back = lists.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy(F.col("cos").desc(), "u"))).where(F.col("r") <= k)
    members = lists.select(F.col("u").alias("centre"), F.col("v").alias("member")).union(back.select("v", "u")).distinct()
    members = members.union(lists.select("u", F.col("u").alias("member")).distinct())
    known = classes.select(F.col("cls").alias("member"), "u").join(bound.withColumnRenamed("u", "member"), "member")
    rows = members.join(known, "member").repartition("centre").sortWithinPartitions("centre")
    return rows.mapInArrow(_around, "a long, b long, cos double")


def _exact(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose cosine in double precision reaches the threshold."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = [(a, b, c) for a, b, v, w in zip(*(batch.column(x).to_pylist() for x in ("a", "b", "v", "w"))) if (c := cosine(v, w)) >= threshold]
        return _edges(*map(list, zip(*keep))) if keep else _edges([], [], [])

    both = pairs.join(classes.select(F.col("cls").alias("a"), F.col("vec").alias("v")), "a")
    both = both.join(classes.select(F.col("cls").alias("b"), F.col("vec").alias("w")), "b")
    return map_batches(both.select("a", "b", "v", "w"), work, "a long, b long, cos double")


def cosine(v: bytes, w: bytes) -> float:
    x, y = np.frombuffer(v, np.float64), np.frombuffer(w, np.float64)
    x, y = x / np.abs(x).max(), y / np.abs(y).max()
    return float(x @ y / np.sqrt((x @ x) * (y @ y)))


def _complete(classes: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """All links inside each component, in tiles of two blocks: cls, linked (vectors of linked classes)."""
    sized = members.groupBy("component").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    rows = members.join(sized, "component").join(classes, members["node"] == classes["cls"])
    rows = rows.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    lo, hi = F.least("own", "with"), F.greatest("own", "with")
    side = F.when(F.col("own") == F.col("with"), F.lit(2)).when(F.col("own") < F.col("with"), F.lit(0)).otherwise(F.lit(1))
    tiles = rows.select("component", (lo * F.col("blocks") + hi).alias("tile"), "cls", "n", "vec", side.alias("side"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def compare():
            cls, n = np.array([r[0] for r in held]), np.array([r[1] for r in held])
            m, side = np.stack([_unit(r[2]) for r in held]), np.array([r[3] for r in held])
            links = m @ m.T
            # the product of unit vectors may differ in the last digits: those near the limit are computed as defined
            for i, j in np.argwhere(np.abs(links - threshold) < 1e-9):
                links[i, j] = cosine(held[i][2], held[j][2])
            links = (links >= threshold) & ~np.eye(len(held), dtype=bool)
            links &= (side[:, None] == 2) | (side[:, None] != side[None, :])
            return pa.RecordBatch.from_arrays([pa.array(cls), pa.array(links @ n)], names=["cls", "linked"])

        for batch in batches:
            for c, t, *row in zip(*(batch.column(x).to_pylist() for x in ("component", "tile", "cls", "n", "vec", "side"))):
                if (c, t) != key:
                    if held:
                        yield compare()
                    key, held = (c, t), []
                held.append(row)
        if held:
            yield compare()

    return tiles.repartition("component", "tile").sortWithinPartitions("component", "tile").mapInArrow(work, "cls long, linked long")


def _bridges(classes: DataFrame, some: DataFrame, lists: DataFrame, members: DataFrame, threshold: float, stages: Stages) -> DataFrame:
    """Links between components of the classes ``some`` (cls): at least one for any two components that such a link joins.

    A class belongs to a ball of its component around the component's smallest class, if that is
    near enough to link, or else around one of its near neighbours. By the triangle inequality of
    angles most pairs of balls have no link; the others are compared in tiles of two blocks.
    """
    reach = float(np.arccos(min(threshold, 1.0)))
    near = lists.where(F.col("cos") >= threshold - SLACK).groupBy("u").agg(F.min_by("v", F.xxhash64("v")).alias("v"), F.min(F.xxhash64("v")).alias("h"))
    near = near.select(F.col("u").alias("cls"), F.when(F.col("h") < F.xxhash64("u"), F.col("v")).otherwise(F.col("u")).alias("leader"))
    own = classes.select("cls", "grp", "vec").join(some, "cls", "left_semi").join(members.withColumnRenamed("node", "cls"), "cls", "left").join(near, "cls", "left")
    own = own.select("cls", "grp", "vec", F.coalesce("component", "cls").alias("component"), F.coalesce("leader", "cls").alias("leader"))
    at = lambda name: classes.select(F.col("cls").alias(name), F.col("vec").alias(f"{name}_vec"))
    own = own.join(at("component"), "component").join(at("leader"), "leader")

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        centre, u, angle = [], [], []
        for root, root_vec, leader, leader_vec, vec in zip(*(batch.column(c).to_pylist() for c in ("component", "component_vec", "leader", "leader_vec", "vec"))):
            x = [float(np.arccos(np.clip(cosine(vec, v), -1, 1))) for v in (root_vec, leader_vec)]
            first = x[0] <= reach or x[0] <= x[1]
            centre.append(root if first else leader)
            u.append(_unit(root_vec if first else leader_vec, np.float32).tobytes())
            angle.append(x[0] if first else x[1])
        columns = [batch.column(c) for c in ("cls", "grp", "vec", "component")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(centre, pa.int64()), pa.array(u, pa.binary()), pa.array(angle, pa.float64())], names=["cls", "grp", "vec", "component", "centre", "u", "angle"])

    placed = map_batches(own, place, "cls long, grp long, vec binary, component long, centre long, u binary, angle double")
    placed = stages.write("placed", placed)
    balls = placed.groupBy("grp", "component", "centre").agg(F.first("u").alias("u"), F.max("angle").alias("radius"), F.count("*").alias("n"))
    balls = stages.write("balls", balls)
    sized = balls.groupBy("grp").agg(F.ceil(F.count("*") / F.lit(BALLS)).cast("int").alias("blocks"), F.count_distinct("component").alias("parts")).where("parts > 1")
    rows = balls.join(sized, "grp").withColumn("own", F.pmod(F.xxhash64("component", "centre"), F.col("blocks")).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    side = F.when(F.col("own") == F.col("with"), F.lit(2)).when(F.col("own") < F.col("with"), F.lit(0)).otherwise(F.lit(1))
    tile = F.least("own", "with") * F.col("blocks") + F.greatest("own", "with")
    tiles = rows.select("grp", tile.cast("long").alias("tile"), "component", "centre", "u", "radius", "n", side.alias("side"))

    def close(key, held) -> pa.RecordBatch:
        component, centre, radius, n, side = (np.array(x) for x in zip(*((r[0], r[1], r[3], r[4], r[5]) for r in held)))
        m = np.frombuffer(b"".join(r[2] for r in held), np.float32).reshape(len(held), -1)
        out = []
        for i in range(0, len(held), BLOCK):
            angles = np.arccos(np.clip(m[i : i + BLOCK] @ m.T, -1, 1))
            may = angles <= radius[i : i + BLOCK, None] + radius[None, :] + reach + 2e-3  # of single precision
            may &= component[i : i + BLOCK, None] < component[None, :]  # each pair once
            may &= (side[i : i + BLOCK, None] == 2) | (side[i : i + BLOCK, None] != side[None, :])
            x, y = np.nonzero(may)
            out.append((x + i, y))
        x, y = (np.concatenate(c) for c in zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (component[x], centre[x], n[x], component[y], centre[y], n[y])], names=["ca", "ba", "na", "cb", "bb", "nb"])

    tiles = tiles.repartition("grp", "tile").sortWithinPartitions("grp", "tile")
    pairs = stages.write("pairs", tiles.mapInArrow(_by_key(("grp", "tile"), ("component", "centre", "u", "radius", "n", "side"), close), "ca long, ba long, na long, cb long, bb long, nb long"))
    blocks = lambda n: F.ceil(F.col(n) / F.lit(BLOCK)).cast("int")

    def half(component: str, centre: str, mine: str, other: str, side: int) -> DataFrame:
        found = pairs.join(placed.select(F.col("component").alias(component), F.col("centre").alias(centre), "cls", "vec"), [component, centre])
        found = found.withColumn("own", F.pmod(F.xxhash64("cls"), blocks(mine)).cast("int"))
        found = found.select("*", F.explode(F.sequence(F.lit(0), blocks(other) - 1)).alias("with"))
        i, j = ("own", "with") if side == 0 else ("with", "own")
        return found.select("ca", "ba", "cb", "bb", F.col(i).alias("i"), F.col(j).alias("j"), F.lit(side).alias("side"), "cls", "vec")

    def compare(key, held) -> pa.RecordBatch:
        a, b = ([r for r in held if r[0] == side] for side in (0, 1))
        if a and b:
            s = np.stack([_unit(r[2]) for r in a]) @ np.stack([_unit(r[2]) for r in b]).T
            i, j = np.nonzero(s >= threshold - 1e-9)
            for k in np.argsort(-s[i, j]).tolist():
                x, y = a[i[k]], b[j[k]]
                if (c := cosine(x[2], y[2])) >= threshold:  # one link joins the components
                    return _edges([x[1]], [y[1]], [c])
        return _edges([], [], [])

    keys = ("ca", "ba", "cb", "bb", "i", "j")
    both = half("ca", "ba", "na", "nb", 0).union(half("cb", "bb", "nb", "na", 1))
    return both.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_by_key(keys, ("side", "cls", "vec"), compare), "a long, b long, cos double")


def _by_key(keys: tuple, columns: tuple, work):
    """Call ``work`` on the rows of each key; rows come sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(x).to_pylist() for x in (*keys, *columns))):
                if row[: len(keys)] != key:
                    if held:
                        yield work(key, held)
                    key, held = row[: len(keys)], []
                held.append(row[len(keys) :])
        if held:
            yield work(key, held)

    return run


def _audit(members: DataFrame, classes: DataFrame, threshold: float) -> float:
    """Share of the links of a bounded set of classes that lie inside a component."""
    probes = classes.orderBy(F.xxhash64("cls", F.lit(7)), "cls").limit(AUDIT_CLASSES).select("cls", "grp", "vec").collect()
    by_group: dict[int, list] = {}
    for r in probes:
        by_group.setdefault(r["grp"], []).append((r["cls"], _unit(bytes(r["vec"]))))
    ready = {g: (np.array([c for c, _ in x]), np.stack([u for _, u in x])) for g, x in by_group.items()}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b, cos = [], [], []
        for group, cls, raw in zip(*(batch.column(x).to_pylist() for x in ("grp", "cls", "vec"))):
            if group in ready:
                ids, m = ready[group]
                s = m @ _unit(raw)
                for i in np.flatnonzero((s >= threshold) & (ids != cls)).tolist():
                    a.append(int(ids[i]))
                    b.append(cls)
                    cos.append(float(s[i]))
        return _edges(a, b, cos)

    true = map_batches(classes.select("grp", "cls", "vec"), work, "a long, b long, cos double").select("a", "b")
    for end in ("a", "b"):
        true = true.join(members.select(F.col("node").alias(end), F.col("component").alias(f"in_{end}")), end, "left")
    hit = true.agg(F.count("*").alias("n"), F.count_if(F.col("in_a") == F.col("in_b")).alias("k")).first()
    return hit["k"] / hit["n"] if hit["n"] else 1.0


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD, k: int = NEIGHBOURS) -> DataFrame:
    """Return vec_id, n_links, component_id and kept (vec_id = component_id) for every vector.

    Vectors link if their labels are equal and not null, they have the same length, and their
    cosine is at least ``threshold``. A vector that is null, empty, all zero, or holds null or
    non-finite components links with nothing. Repeated rows are vectors of their own and link.
    Null ids are allowed: a component takes its smallest id that is not null. Other columns are ignored.
    """
    spark = vectors.sparkSession
    stages = Stages(spark, "embeddings")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    ready = stages.write("ready", map_batches(rows, _prepare, "vec_id long, grp long, cls long, vec binary"))
    grouped = ready.where("cls IS NOT NULL").groupBy("cls").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.min("grp").alias("grp"), F.max("vec").alias("vec"))

    def shorten(batch: pa.RecordBatch) -> pa.RecordBatch:
        u = [_unit(v, np.float32).tobytes() for v in batch.column("vec").to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(u, pa.binary())], names=[*batch.schema.names, "u"])

    classes = stages.write("classes", map_batches(grouped, shorten, "cls long, rep long, n long, grp long, vec binary, u binary"))
    count = classes.count()
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), count // 500 + 1))
    bits = int(np.clip(np.log2(max(count, 2)) - 3, 4, 20))
    lists, step = None, 0

    def components(edges: DataFrame, lists: DataFrame, some: DataFrame) -> DataFrame:
        members = stages.write("members", connected_components(edges, "a", "b", stages))
        if some.isEmpty():
            return members
        found = stages.write("bridges", _bridges(classes, some, lists, members, threshold, stages))
        return members if found.isEmpty() else stages.write("joined", connected_components(edges.union(found), "a", "b", stages))

    for attempt in range(MOST_TRIES):
        coded = map_batches(classes.select("grp", "cls", "vec"), _codes(bits, attempt), "grp long, tab int, code long, place double, cls long, u binary")
        coded = coded.repartitionByRange(parts, "grp", "tab", "code", "place").sortWithinPartitions("grp", "tab", "code", "place")
        pairs = coded.mapInArrow(_adjacent, "a long, b long, cos double")
        if lists is not None:
            pairs = pairs.union(lists.select(F.col("u").alias("a"), F.col("v").alias("b"), "cos"))
        size = k * 2**attempt
        lists = stages.write(f"lists{step}", _best(pairs, size))
        for _ in range(MOST_ROUNDS):
            found = _refine(lists, classes, size).union(lists.select(F.col("u").alias("a"), F.col("v").alias("b"), "cos"))
            new = stages.write(f"lists{step + 1}", _best(found, size))
            changed = new.join(lists, ["u", "v"], "left_anti").count()
            stages.drop(f"lists{step}")
            lists, step = new, step + 1
            if changed <= LEAST_CHANGE * count * size:
                break
        near = lists.where(F.col("cos") >= threshold - SLACK).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
        edges = stages.write("edges", _exact(near, classes, threshold))
        saturated = lists.where((F.col("nth") >= size) & (F.col("cos") >= threshold - SLACK)).select(F.col("u").alias("cls"))
        members = components(edges, lists, saturated)
        if _audit(members, classes, threshold) >= AUDIT_RECALL:
            break
    else:
        members = components(edges, lists, classes.select("cls"))
    inside = _complete(classes.select("cls", "n", "vec"), members, threshold).groupBy("cls").agg(F.sum("linked").alias("linked"))
    known = classes.select("cls", "rep", "n").join(members, classes["cls"] == members["node"], "left")
    known = known.select("cls", "rep", "n", F.coalesce("component", "cls").alias("component"))
    least = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    done = known.join(least, "component").join(inside, "cls", "left")
    done = stages.write("done", done.select("cls", "component_id", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")))
    out = ready.select("vec_id", "cls").join(done, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
