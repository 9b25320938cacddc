"""Near-duplicate documents by a token-group matrix over word n-grams.

Two documents link when the Jaccard similarity of their sets of distinct n-word
shingles reaches ``t = num / den``. The join is exact (on 64-bit shingle keys).

1. In how many sets each shingle is, is found by a key exchange between blocks
   (``blocks.py``); keys are cut to 48 bits there, as the counts only order shingles.
2. Sets are ordered rarest first. Of two linked sets the larger has a common shingle
   among its first ``n - ceil(t n) + 1`` (its *probes*), and the smaller among its first
   ``n - ceil(2 t n / (1 + t)) + 1`` (its *index*). Documents of equal sets are one class.
3. Classes are partitioned into groups of similar ones: a class goes to the group of the
   least class that shares a probe with it, and large groups are cut into parts. Each part
   is opened once, together with the group's leader: its classes are compared with each
   other, and the union of their shingles is stored. So a crowd of near copies becomes one
   component through its leader.
4. The token-group matrix holds which shingles occur in which part, with the sizes and
   components of the classes that have them. A class queries the parts that share a probe
   or index shingle with it and hold other components.
5. A stored union bounds the overlap of a query with every class of the part. Only where the
   bound reaches the threshold is the part opened: then its classes are shipped and compared.
6. Components of all links, by joins (``components.py``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Block, answer_keys, buckets, send_keys, total, with_answers, write_blocks
from .components import components
from .textkit import U64, Texts, pack_keys, unpack_keys
from .workspace import Workspace

GROUP = 128
QUERIES = 512
COLUMNS = 8_192
KEPT_BITS = ~U64(0xFFFF)
ROW = "kind int, rid long, doc_id long, n long, high long, low long, token long, front boolean, keys binary"
ROW_ARROW = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in ("rid", "doc_id", "n", "high", "low", "token")), ("front", pa.bool_()), ("keys", pa.binary())])
LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])
PART = pa.schema([("home", pa.int64()), ("part", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("keys", pa.binary())])


def digest(keys: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted key array: two sums of independently mixed keys, and the size."""
    from .textkit import mix

    size = U64(len(keys))
    high = mix(np.array([mix(keys ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64) + size], U64))
    low = mix(np.array([mix(keys + U64(0x14057B7EF767814F)).sum(dtype=U64) ^ size], U64))
    return int(high.view(np.int64)[0]), int(low.view(np.int64)[0])


def _sets(block: Block, words: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each text's shingle set; the block's distinct shingles, cut to KEPT_BITS, and in how many different sets each is."""
    sets = Texts(block.texts).shingles(words)
    seen: dict[tuple, int] = {}
    for d, s in enumerate(sets):
        if len(s):
            seen.setdefault((len(s), *digest(s)), d)
    if not seen:
        return sets, np.empty(0, U64), np.empty(0, np.int64)
    every = np.sort(np.concatenate([sets[d] for d in seen.values()]) & KEPT_BITS)
    at = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    return sets, every[at], np.diff(np.append(at, len(every)))


def needed(n: int, num: int, den: int) -> int:
    """Least overlap of a set of n with any set that it links to."""
    return -(-n * num // den)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def fits(a: int, b: int, num: int, den: int) -> bool:
    """Whether sets of these sizes can link."""
    return a * den >= b * num and b * den >= a * num


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if not fits(len(a), len(b), num, den):
        return False
    i = overlap(a, b)
    return den * i >= num * (len(a) + len(b) - i)


def overlaps(sets: list[np.ndarray], union: np.ndarray) -> np.ndarray:
    """How many shingles each two of some sets have in common, by matrix products over slices of their union."""
    n = len(sets)
    columns = np.searchsorted(union, np.concatenate(sets))
    rows = np.repeat(np.arange(n), list(map(len, sets)))
    order = np.argsort(columns, kind="stable")
    columns, rows = columns[order], rows[order]
    common = np.zeros((n, n))
    cuts = np.searchsorted(columns, np.arange(0, len(union) + COLUMNS, COLUMNS))
    for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
        m = np.zeros((n, min(COLUMNS, len(union) - k * COLUMNS)), np.float32)
        m[rows[i:j], columns[i:j] - k * COLUMNS] = 1
        common += m @ m.T
    return common.astype(np.int64)


def spanning(sets: list[np.ndarray], union: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links that join the same sets as all links between ``sets`` do."""
    if len(sets) < 2:
        return []
    sizes = np.array(list(map(len, sets)))
    if len(sets) == 2:
        pairs = [(0, 1)] if linked(*sets, num, den) else []
    else:
        common = overlaps(sets, union)
        pairs = np.argwhere(np.triu(den * common >= num * (sizes[:, None] + sizes[None, :] - common), 1)).tolist()
    root, out = list(range(len(sets))), []

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            root[y] = x
            out.append((a, b))
    return out


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 75, den: int = 100, id_col: str = "doc_id", text_col: str = "text", space: Workspace | None = None, tidy: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, rid. Tables on the way go at the end if ``tidy``.

    component_id is the least non-null doc_id of the rows it reaches by links, itself
    included. Null or wordless texts have an empty set, link with nothing and keep their
    own doc_id. Rows with equal text but another or the same doc_id link with each other;
    a null doc_id gives the component of its text (null if it links with nothing). An
    empty table gives no rows. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    space = space or Workspace(spark, "ngramjoin")
    blocks = write_blocks(docs, space, id_col, text_col)

    n = buckets(blocks)
    answers = answer_keys(send_keys(blocks, n, lambda b: _sets(b, words)[1:]), n, total)

    def sketch(block: Block, freq: np.ndarray) -> list[dict]:
        sets, keys, _ = _sets(block, words)
        rows, sent = [], set()
        for rid, doc, s in zip(block.rid.tolist(), block.doc_ids(), sets):
            n = len(s)
            high, low = digest(s) if n else (0, 0)
            row = {"kind": 0, "rid": rid, "doc_id": doc, "n": n, "high": high, "low": low, "token": None, "front": None, "keys": None}
            rows.append(row)
            if not n or (n, high, low) in sent:
                continue
            sent.add((n, high, low))
            f = freq[np.searchsorted(keys, s & KEPT_BITS)]
            first = np.lexsort((s, f))[: n - needed(n, num, den) + 1]
            front = np.arange(len(first)) < n - needed(2 * n, num, num + den) + 1
            shared = f[first] > 1
            if shared.any():
                rows.append(row | {"kind": 1, "keys": pack_keys(s)})
                rows += [row | {"kind": 2, "token": t, "front": x} for t, x in zip(s[first[shared]].view(np.int64).tolist(), front[shared].tolist())]
        return rows

    rows = space.write(with_answers(blocks, answers, sketch, ROW, ROW_ARROW), "rows")
    space.drop("blocks")

    # a set's first row, block by block, is the row that sent its shingles: the least row names the class
    of = ["n", "high", "low"]
    docs_in = rows.filter("kind = 0")
    classes = docs_in.filter("n > 0").groupBy(*of).agg(F.min("rid").alias("class"))
    sets = rows.filter("kind = 1").groupBy(*of).agg(F.min_by("keys", "rid").alias("keys"), F.min("rid").alias("class"))
    tokens = space.write(rows.filter("kind = 2").groupBy("token", *of).agg(F.min("rid").alias("class"), F.first("front").alias("front")).select("token", "class", "n", "front"), "tokens")
    shared = tokens.groupBy("token").agg(F.min(F.when(F.col("front"), F.col("class"))).alias("hub"), F.count("*").alias("f")).filter("f > 1 and hub is not null")
    tokens = space.write(tokens.join(shared.select("token", "hub"), "token"), "shared")

    members = tokens.groupBy("class", "n").agg(F.min("hub").alias("home"))
    crowd = members.groupBy("home").agg(F.count("*").alias("size")).filter("size > 1")
    members = space.write(members.join(crowd, "home", "left").select("class", "n", "home", F.expr(f"cast(pmod(xxhash64(class), ceil(coalesce(size, 1) / {GROUP})) as long)").alias("part")), "members")
    # only what is in a group is compared
    keyed = space.write(sets.select("class", "keys").join(members.select("class"), "class", "left_semi"), "sets")

    def first_opening(table: pa.Table) -> pa.Table:
        rows = table.select(["home", "part", "class", "mine", "keys"]).to_pylist()
        here = {r["class"]: unpack_keys(r["keys"]) for r in rows}
        names, own = list(here), [unpack_keys(r["keys"]) for r in rows if r["mine"]]
        union = np.unique(np.concatenate(own))
        whole = union if len(own) == len(here) else np.union1d(union, here[rows[0]["home"]])
        at = {"home": rows[0]["home"], "part": rows[0]["part"]}
        out = [at | {"keys": pack_keys(union), "a": None, "b": None}]
        out += [at | {"keys": None, "a": names[i], "b": names[j]} for i, j in spanning([here[c] for c in names], whole, num, den)]
        return pa.Table.from_pylist(out, PART)

    place = ["home", "part"]
    own = members.select(*place, "class", F.lit(True).alias("mine"))
    leaders = members.select(*place).distinct().select(*place, F.col("home").alias("class"), F.lit(False).alias("mine"))
    gathered = own.union(leaders).groupBy(*place, "class").agg(F.max("mine").alias("mine")).join(keyed, "class")
    parts = space.write(gathered.groupBy(*place).applyInArrow(first_opening, "home long, part long, a long, b long, keys binary"), "parts")
    links = parts.filter("a is not null").select("a", "b")
    unions = parts.filter("a is null").select(*place, F.col("keys").alias("held"))
    part = components(links, space, "part")

    # what shares a shingle but is not yet one component
    placed = tokens.join(part.withColumnRenamed("node", "class"), "class", "left").withColumn("comp", F.coalesce("root", "class"))
    mixed = placed.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("token")
    left = space.write(placed.join(mixed, "token").join(members.select("class", *place), "class").select("token", "class", "n", "front", "comp", *place), "left")
    matrix = left.groupBy("token", *place).agg(F.max("front").alias("fronts"), F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    # of each token's components the largest is asked and does not ask
    weight = left.select("class", "comp").distinct().groupBy("comp").agg(F.count("*").alias("weight"))
    comps = left.select("token", "comp").distinct().join(weight, "comp")
    first = comps.groupBy("token").agg(F.max(F.struct("weight", "comp")).alias("top")).select("token", F.col("top.comp").alias("top"))
    queries = left.join(first, "token").filter("comp <> top").select("token", F.col("class").alias("q"), F.col("n").alias("nq"), F.col("comp").alias("cq"), F.col("front").alias("fq"))
    can = f"(fq or fronts) and nq * {den} >= n0 * {num} and n1 * {den} >= nq * {num} and not (c0 = cq and c1 = cq)"
    asked = space.write(queries.join(matrix, "token").filter(can).select("q", "cq", *place).distinct(), "asked")
    many = asked.groupBy(*place).agg(F.ceil(F.count("*") / QUERIES).alias("turns"))
    turned = asked.join(many, place).withColumn("turn", F.expr("pmod(xxhash64(q), turns)"))
    turns = many.select(*place, F.explode(F.expr("sequence(0L, turns - 1)")).alias("turn"))
    of_query = keyed.select(F.col("class").alias("q"), F.col("keys").alias("asks"))
    here = [*place, "turn"]

    def bound(left: pa.Table, right: pa.Table) -> pa.Table:
        """Queries that the part's union does not rule out."""
        union, out = unpack_keys(right.column("held")[0].as_py()), []
        for r in left.to_pylist():
            key = unpack_keys(r["asks"])
            if overlap(key, union) >= needed(len(key), num, den):
                out.append({c: r[c] for c in ("home", "part", "turn", "q", "cq")})
        return pa.Table.from_pylist(out, pa.schema([(c, pa.int64()) for c in ("home", "part", "turn", "q", "cq")]))

    ask = turned.join(of_query, "q").select(*here, "q", "cq", "asks").groupBy(*here)
    other = [F.col(c).alias(f"of_{c}") for c in here]
    answer = turns.join(unions, place).select(*other, "held").groupBy(*(f"of_{c}" for c in here))
    qualified = space.write(ask.cogroup(answer).applyInArrow(bound, "home long, part long, turn long, q long, cq long"), "qualified")

    def opened(left: pa.Table, right: pa.Table) -> pa.Table:
        group, out = [(r["class"], r["comp"], unpack_keys(r["keys"])) for r in right.to_pylist()], []
        for r in left.to_pylist():
            key, joined = unpack_keys(r["asks"]), {r["cq"]}
            for c, comp, k in group:
                if comp not in joined and linked(key, k, num, den):
                    joined.add(comp)
                    out.append({"a": r["q"], "b": c})
        return pa.Table.from_pylist(out, LINK)

    shipped = qualified.select(*here).distinct().join(left.select("class", "comp", *place).distinct(), place).join(keyed, "class").select(*other, "class", "comp", "keys")
    more = space.write(qualified.join(of_query, "q").select(*here, "q", "cq", "asks").groupBy(*here).cogroup(shipped.groupBy(*(f"of_{c}" for c in here))).applyInArrow(opened, "a long, b long"), "more_links")
    roots = components(links.union(more), space, "whole")

    whole = docs_in.filter("n > 0").join(classes, of).select("rid", "doc_id", "n", F.col("class"))
    whole = whole.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    names = whole.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = whole.join(names, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "rid")
    out = out.unionByName(docs_in.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "rid"))
    found = space.write(out, "found")
    if tidy:
        for name in ("rows", "tokens", "shared", "members", "sets", "parts", "left", "asked", "qualified", "more_links"):
            space.drop(name)
    return found
