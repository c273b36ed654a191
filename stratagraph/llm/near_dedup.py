"""Near-duplicates on word shingles: MinHash signatures, a multi-index Hamming join, confirmation on full sets."""

from __future__ import annotations

from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import Scratch, give_back, join_counted, table, text_col
from .components import components

#: A signature has CHUNKS chunks of WIDTH symbols of 16 bits. Two signatures that differ in at most RADIUS symbols have a
#: chunk with at most RADIUS // CHUNKS = 1 differing symbols. At a similarity of 0.85 a symbol differs with probability 0.15;
#: that more than 23 of 60 do has probability 2e-6.
CHUNKS, WIDTH = 12, 5
RADIUS = 23
_SYMBOLS = CHUNKS * WIDTH
#: Most of the links at the threshold itself that may lie beyond the radius.
MISSED = 1e-5
#: Classes into which the sizes fall that a set can be linked with.
SIZE_CLASSES = 12
_SEEDS = words.mix(np.arange(1, _SYMBOLS + 1, dtype=np.uint64))[:, None]
_ODD = (words.mix(np.arange(1001, 1001 + _SYMBOLS, dtype=np.uint64)) | np.uint64(1))[:, None]


def beyond(percent: int, radius: int) -> float:
    """Probability that signatures of two sets of a similarity of percent differ in more than radius symbols."""
    differ = 1 - percent / 100
    return sum(comb(_SYMBOLS, k) * differ**k * (1 - differ) ** (_SYMBOLS - k) for k in range(radius + 1, _SYMBOLS + 1))


def layout(percent: int) -> tuple[int, int]:
    """Chunks and their width for links of percent: the widest chunks whose radius, 2 * chunks - 1, at most MISSED of them exceed;
    CHUNKS and WIDTH from 85 on, 15 chunks of 4 at 80."""
    for width in range(WIDTH, 1, -1):
        if _SYMBOLS % width == 0 and beyond(percent, 2 * (_SYMBOLS // width) - 1) <= MISSED:
            return _SYMBOLS // width, width
    return _SYMBOLS // 2, 2


def signature(shingle_set: np.ndarray) -> np.ndarray:
    """60 symbols: 16 bits of the least of each of 60 hash functions over the set."""
    least = np.full(_SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingle_set), 2048):
        least = np.minimum(least, (((shingle_set[None, i : i + 2048] ^ _SEEDS) * _ODD) >> np.uint64(16)).min(axis=1))
    return (least & np.uint64(0xFFFF)).astype(np.uint16)


def _sets(batch: pa.RecordBatch, k: int):
    """(doc_id, ascending distinct shingle hashes) of each row."""
    ids = batch.column(0).to_pylist()
    off, raw = words.buffer_of(batch.column(1))
    for i, j in words.slices(off):
        h, at = words.words(off[i : j + 1] - off[i], raw[off[i] : off[j]])
        s, doc = words.shingles(h, at, k)
        n = len(np.flatnonzero(np.diff(at) >= k)) and int(np.maximum(np.diff(at) - k + 1, 0).sum())
        bounds = np.searchsorted(doc[:n], np.arange(j - i + 1))
        short = {int(d): s[n + x : n + x + 1] for x, d in enumerate(doc[n:])}
        for d in range(j - i):
            mine = short.get(d)
            if mine is None:
                mine = np.sort(s[bounds[d] : bounds[d + 1]])
                if len(mine) > 1:
                    mine = mine[np.concatenate([[True], mine[1:] != mine[:-1]])]
            yield ids[i + d], mine


def _source(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_col(docs, text).alias("text"))


def signatures(docs: DataFrame, k: int = 5, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (two sums that stand for the set), signature (binary) of every row."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("signature", pa.binary())])
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            with np.errstate(over="ignore"):
                for doc_id, s in _sets(batch, k):
                    for c, x in zip(cols, (doc_id, *_stands(s), signature(s).tobytes()), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
        give_back()

    return _source(docs, text).mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, signature binary")


def _keys(classes: DataFrame, chunks: int = CHUNKS, width: int = WIDTH) -> DataFrame:
    """key, rep, slot for each chunk with each of its symbols left out in turn: equal keys are chunks with one error at most.
    slot is width * chunk + the symbol left out."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(x.as_py() for x in batch.column(1)), np.uint16).reshape(-1, chunks, width).astype(np.uint64)
            rep, out = batch.column(0), []
            with np.errstate(over="ignore"):
                for c in range(chunks):
                    for left in range(width):
                        packed = np.zeros(len(sig), np.uint64)
                        for w in range(width):
                            if w != left:
                                packed = packed << np.uint64(16) | sig[:, c, w]
                        out.append(words.mix(packed ^ words.mix(np.array([c * width + left + 1], np.uint64))).view(np.int64))
            for slot, keys in enumerate(out):
                yield pa.RecordBatch.from_arrays([pa.array(keys), rep, pa.array(np.full(len(keys), slot, np.int32))], names=["key", "rep", "slot"])
        give_back()

    return classes.select("rep", "signature").mapInArrow(run, "key long, rep long, slot int")


def _planes(classes: DataFrame, chunks: int = CHUNKS, width: int = WIDTH) -> DataFrame:
    """p_rep, planes: the signature's symbols as 16 planes of bits, symbol w of chunk c at bit chunks * w + c, so that the
    symbols in which two signatures differ are the bits of plane-wise xor, or-ed."""

    def run(batches):
        weight = np.uint64(1) << np.arange(_SYMBOLS, dtype=np.uint64)
        for batch in batches:
            if batch.num_rows:
                sig = np.frombuffer(b"".join(x.as_py() for x in batch.column(1)), np.uint16).reshape(-1, chunks, width).transpose(0, 2, 1).reshape(-1, _SYMBOLS)
                planes = np.stack([((sig >> np.uint16(j)) & np.uint16(1)).astype(np.uint64) @ weight for j in range(16)], axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(planes), pa.list_(pa.int64()))], names=["p_rep", "planes"])

    return classes.select("rep", "signature").mapInArrow(run, "p_rep long, planes array<long>")


def _first_slot(slot: str, a: str, b: str, chunks: int = CHUNKS, width: int = WIDTH):
    """Whether slot is the first in which signatures of planes a and b share a key, and they are within the radius: of all the
    keys that two signatures share, one gives the pair."""
    every = (1 << chunks) - 1

    def told(mask):
        by_symbol = [F.shiftrightunsigned(mask, chunks * w).bitwiseAND(F.lit(every)) for w in range(width)]
        one, two = by_symbol[0], None
        for x in by_symbol[1:]:
            both = one.bitwiseAND(x)
            two = both if two is None else two.bitwiseOR(both)
            one = one.bitwiseOR(x)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.floor(F.col(slot) / width).cast("int"))
        # Chunks of two errors or more are no match; this one is the first match if all before it are such.
        first = (bit - 1).bitwiseAND(F.bitwise_not(two)) == 0
        left = F.col(slot) % width
        gone = F.coalesce(*[F.when(left == w, by_symbol[w]) for w in range(width)]).bitwiseAND(bit) != 0
        none = one.bitwiseAND(bit) == 0
        return (F.bit_count(mask) <= 2 * chunks - 1) & first & (gone | (none & (left == 0)))

    mask = F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))
    return F.get(F.transform(F.array(mask), told), F.lit(0))


def _stands(s: np.ndarray) -> tuple[int, int, int]:
    """Size and two sums that stand for a set."""
    with np.errstate(over="ignore"):
        other = words.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        return len(s), int(s.sum(dtype=np.uint64).view(np.int64)), int(other.sum(dtype=np.uint64).view(np.int64))


def _full_sets(docs: DataFrame, k: int, text: str) -> DataFrame:
    def run(batches):
        schema = pa.schema([("f_n", pa.int64()), ("f_a", pa.int64()), ("f_b", pa.int64()), ("shingles", pa.list_(pa.int64()))])

        def made(stands, sets):
            return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in zip(*stands, strict=True)], pa.array(sets, schema[3].type)], schema=schema)

        for batch in batches:
            stands, sets, held = [], [], 0
            for _, s in _sets(batch, k):
                stands.append(_stands(s))
                sets.append(s.view(np.int64))
                held += len(s)
                if held > 500_000:
                    yield made(stands, sets)
                    stands, sets, held = [], [], 0
            if stands:
                yield made(stands, sets)
        give_back()

    return _source(docs, text).mapInArrow(run, "f_n long, f_a long, f_b long, shingles array<long>")


def _across(held: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """a, b, a_comp, b_comp for all rows of held (rep, n, comp) that a link of percent joins across components, and some that it
    does not; sets (rep, shingles) holds their sets.

    In an order of all shingles the first that two sets share stands so early in both that what comes after it suffices for the
    overlap that their sizes n, m ask for, (n + m) * percent / (100 + percent). Shingles of one component only come first, as
    no pair shares them, then those of fewest holders. So what a large group has in common comes last, and of its members only
    those meet that share something rare besides.

    A set is filed at its first shingles under the class of its own size, and looks up those of its own and of smaller sizes,
    for each class as far as that asks for. At each shingle rows of the component that has most of them do not meet each other.
    """
    step = SIZE_CLASSES / log(100 / min(percent, 99))
    spread = held.join(sets.withColumnRenamed("rep", "s_rep"), F.col("rep") == F.col("s_rep")).select("rep", "n", "comp", F.explode("shingles").alias("s"))
    shared = spread.groupBy("s").agg(F.count("*").alias("holders"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("s", "holders")
    shared = scratch.write(shared, "shared")
    spread = join_counted(spread, ["s"], shared, "holders", held.agg(F.sum("n")).first()[0], "rep").where("holders IS NOT NULL")
    ranked = spread.groupBy("rep", "n", "comp").agg(F.sort_array(F.collect_list(F.struct("holders", "s"))).alias("ranked"))
    ranked = ranked.withColumn("u", F.col("n") - F.size("ranked")).where(f"100 * (n - u) >= {percent} * n")
    ranked = scratch.write(ranked, "ranked")

    def size_class(size):
        return F.floor(F.log(size) * step).cast("int")

    def first(df: DataFrame, other: str) -> DataFrame:
        reach = F.expr(f"cast(greatest(0, n - ({percent} * (n + {other}) + {99 + percent}) div {100 + percent} + 1 - u) AS int)")
        df = df.select("rep", "n", "u", "comp", "class", "small", F.posexplode(F.slice("ranked", F.lit(1), reach)).alias("at", "x"))
        return df.select("rep", "n", "u", "comp", "class", "small", (F.col("u") + F.col("at") + 1).alias("at"), F.col("x.s").alias("s"))

    filed = first(ranked.withColumn("class", size_class(F.col("n"))).withColumn("small", F.lit(True)), "n")
    least = F.expr(f"({percent} * n + 99) div 100")
    sought = ranked.withColumn("class", F.explode(F.sequence(size_class(least), size_class(F.col("n"))))).withColumn("small", F.lit(False))
    # The least size of the class, or less by a rounding error.
    sought = sought.withColumn("lo", F.greatest(least, F.floor(F.exp(F.col("class") / step) * (1 - 1e-9))))
    rows = scratch.write(filed.unionByName(first(sought, "lo")), "filed")
    most = rows.groupBy("s", "class", "comp").agg(F.count("*").alias("c")).groupBy("s", "class").agg(F.sum("c").alias("of"), F.count("*").alias("comps"), F.max_by("comp", F.struct("c", "comp")).alias("most"))
    most = scratch.write(most.where("comps > 1").drop("comps"), "most")
    rows = join_counted(rows, ["s", "class"], most, "of", rows.count(), "rep").where("most IS NOT NULL")
    # Part 1: filed rows of all other components and all that seek; part 2: those of the most frequent one and the others that seek.
    a = rows.where("small").select("s", "class", F.expr("if(comp = most, 2, 1)").alias("part"), F.col("rep").alias("a"), "n", "u", F.col("comp").alias("a_comp"), "at")
    b = rows.where("NOT small").select("s", "class", F.explode(F.expr("if(comp = most, array(1), array(1, 2))")).alias("part"), F.col("rep").alias("b"), F.col("n").alias("m"), F.col("u").alias("v"), F.col("comp").alias("b_comp"), F.col("at").alias("b_at"))
    pairs = a.join(b, ["s", "class", "part"]).where("a_comp <> b_comp AND (n < m OR n = m AND a < b)")
    pairs = pairs.where(f"{100 + percent} * (1 + least(n - at, m - b_at)) >= {percent} * (n + m)")
    return pairs.where(f"100 * least(n - u, m - v) >= {percent} * greatest(n + v, m + u)").select("a", "b", "a_comp", "b_comp").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = 5, text: str = "text", pivot_rounds: int = 3, broadcast_rows: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Rows are linked when 100 * intersection >= percent * union of their sets of k-word shingles, confirmed on full sets;
    component_id is the smallest doc_id reachable over links, kept marks the row that has it as doc_id.

    Candidates are those whose 60-symbol signatures agree in a chunk up to one error, which by pigeonhole are all pairs
    within 2 * chunks - 1 differing symbols; layout cuts the chunks for percent. Equal sets are one class first.

    A set's own shingles, those that no other candidate has, bound its similarity to any other: of sizes n, m with u, v own
    shingles the intersection is at most min(n - u, m - v) and the union at least max(n + v, m + u). Sets and pairs that
    can't reach percent by that go. Within a key no list of all pairs is made: a pivot for each key is compared with its
    members and confirmed links join components; keys whose members are one component by then are done. The first pivot is
    the member that shares most keys with most others, which of a group of edits is the text they were made from. Sets with
    keys that are left after pivot_rounds pivots are compared across components where they share one of their rarest shingles,
    as any two that are linked do (_across), so no linked candidate pair between different components goes unconfirmed.

    Null, empty and word-less texts have an empty set and are linked with nothing. A text of fewer than k words is one
    shingle. Rows that repeat a doc_id with different texts are linked through that id. A row without a doc_id is linked like
    any other, but gives its component no id; a component of such rows only has component_id null and keeps them all. An empty
    table gives an empty result; other columns are ignored.

    Classes of equal sets are numbered once, in a table, and known by that number throughout.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    sigs = scratch.write(signatures(docs, k, text), "signatures")
    alike = ["n_shingles", "set_a", "set_b"]
    classes = sigs.where("n_shingles > 0").groupBy(*alike).agg(F.min("doc_id").alias("least"), F.first("signature").alias("signature"), F.count("*").alias("n_rows"))
    classes = scratch.write(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    cut = layout(percent)
    keys = _keys(classes, *cut)
    shared = keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select(F.col("key").alias("k"), "members")
    rows = scratch.write(keys.join(shared, keys["key"] == shared["k"]).groupBy("key", "rep").agg(F.max("members").alias("members")), "rows")
    involved = rows.select(F.col("rep").alias("i_rep")).distinct()
    involved = scratch.write(classes.join(involved, classes["rep"] == involved["i_rep"]).select("rep", "least", *alike), "involved")
    n_involved = involved.count()
    # Sets are cut again from the texts of the rows with the classes' least ids; what stands for a set tells its class.
    ids = involved.select(F.col("least").alias("id")).distinct()
    if n_involved <= broadcast_rows:
        chosen = docs.join(F.broadcast(ids), docs["doc_id"].cast("long").eqNullSafe(ids["id"]), "left_semi")
    else:  # rows without an id are all taken, so that null is no frequent key
        chosen = docs.join(ids, docs["doc_id"].cast("long") == ids["id"], "left_semi").unionByName(docs.where(docs["doc_id"].isNull()))
    sets = _full_sets(chosen, k, text)
    of = F.broadcast(involved.drop("least")) if n_involved <= broadcast_rows else involved.drop("least")
    sets = sets.join(of, (sets["f_n"] == of["n_shingles"]) & (sets["f_a"] == of["set_a"]) & (sets["f_b"] == of["set_b"])).select("rep", "shingles")
    # Rows with the least id may have equal sets: one row of each class is enough.
    sets = scratch.write(sets.dropDuplicates(["rep"]), "sets")
    own = sets.select("rep", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("holders"), F.min("rep").alias("owner")).where("holders = 1").groupBy("owner").agg(F.count("*").alias("u"))
    worth = rows.groupBy("rep").agg(F.sum("members").alias("worth")).withColumnRenamed("rep", "w_rep")
    marked = sets.select(F.col("rep").alias("id"), F.size("shingles").cast("long").alias("n")).join(own, F.col("id") == own["owner"], "left").join(worth, F.col("id") == worth["w_rep"])
    marked = marked.select("id", "n", F.coalesce("u", F.lit(0)).alias("u"), "worth").where(f"100 * (n - u) >= {percent} * n")
    marked = scratch.write(marked, "marked")
    live_rows = rows.join(marked, rows["rep"] == marked["id"]).select("key", "rep", "n", "u", "worth")
    rows = scratch.write(live_rows, "live")
    comp = scratch.write(marked.select("id", F.col("id").alias("comp")), "comp")
    close = f"100 * least(n - u, m - v) >= {percent} * greatest(n + v, m + u)"

    def labelled() -> DataFrame:
        return rows.join(comp, rows["rep"] == comp["id"]).select("key", "rep", "n", "u", "worth", "comp")

    def confirmed(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("rep").alias("a_rep"), F.col("shingles").alias("a_set"))
        b = sets.select(F.col("rep").alias("b_rep"), F.col("shingles").alias("b_set"))
        j = pairs.join(a, pairs["a"] == a["a_rep"]).join(b, pairs["b"] == b["b_rep"])
        j = j.withColumn("both", F.size(F.array_intersect("a_set", "b_set")))
        return j.where(f"100L * both >= {percent}L * (size(a_set) + size(b_set) - both)").select("a", "b", "a_comp", "b_comp")

    for r in range(pivot_rounds + 1):
        live = scratch.write(labelled(), f"labelled{r}")
        first = F.struct(-F.col("worth") if r == 0 else F.lit(0), F.xxhash64("rep", F.lit(r)))
        open_keys = live.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by(F.struct("rep", "n", "u", "comp"), first).alias("p")).where("lo < hi")
        open_keys = open_keys.select(F.col("key").alias("k"), F.col("p.rep").alias("b"), F.col("p.n").alias("m"), F.col("p.u").alias("v"), F.col("p.comp").alias("b_comp"))
        open_keys = scratch.write(open_keys, f"open{r}")
        if open_keys.isEmpty():
            break
        left = live.join(open_keys, live["key"] == open_keys["k"])
        if r == pivot_rounds:
            held = scratch.write(left.select("rep", "n", "comp").distinct(), "left")
            pairs = _across(held, sets, percent, scratch)
        else:
            pairs = left.where(F.col("comp") != F.col("b_comp")).where(close).select(F.col("rep").alias("a"), "b", F.col("comp").alias("a_comp"), "b_comp").distinct()
        pairs = scratch.write(pairs, f"pairs{r}")
        scratch.drop_table(live)
        if pairs.isEmpty():
            continue  # nothing of a fitting size with these pivots
        links = confirmed(pairs)
        joined = components(links.select(F.col("a_comp").alias("u"), F.col("b_comp").alias("v")), scratch)
        comp = scratch.write(comp.join(joined, comp["comp"] == joined["node"], "left").select("id", F.coalesce("component", "comp").alias("comp")), f"comp{r}")
    members = classes.join(comp, classes["rep"] == comp["id"], "left").select(*alike, "n_rows", "least", "rep", F.coalesce("comp", "rep").alias("comp"))
    # Classes that share a doc_id are linked by it.
    twice = sigs.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(*[f(F.struct(*alike)).alias(n) for f, n in ((F.min, "lo"), (F.max, "hi"))]).where("lo <> hi").select(F.col("doc_id").alias("t"))
    twice = scratch.write(twice, "twice")
    if not twice.isEmpty():
        held = sigs.where("n_shingles > 0").join(twice, sigs["doc_id"] == twice["t"], "left_semi").select("doc_id", *alike).distinct()
        held = held.join(members.select(*alike, "comp"), alike).select("doc_id", "comp")
        through = held.groupBy("doc_id").agg(F.min("comp").alias("u")).withColumnRenamed("doc_id", "t")
        joined = components(held.join(through, held["doc_id"] == through["t"]).select("u", F.col("comp").alias("v")), scratch)
        members = members.join(joined, members["comp"] == joined["node"], "left").select(*alike, "n_rows", "least", "rep", F.coalesce("component", "comp").alias("comp"))
    members = scratch.write(members, "members")
    named = members.groupBy("comp").agg(F.min("least").alias("component_id"), F.count("*").alias("size")).where("size > 1")
    members = join_counted(members, ["comp"], named, "size", members.count(), "rep")
    members = scratch.write(members.select(*alike, "n_rows", F.coalesce("component_id", "least").alias("component_id")), "members")
    marked = join_counted(sigs.where("n_shingles > 0"), alike, members, "n_rows", sigs.count(), "doc_id")
    out = marked.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    out = out.unionByName(sigs.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))
    return scratch.tied_to(out)


def drop_near_duplicates(docs: DataFrame, broadcast_rows: int = 1_000_000, **how) -> DataFrame:
    """docs with one row of each component of near-duplicates, that of the smallest doc_id; all columns as they were. Rows
    without a doc_id stay, as nothing but their text tells them apart, and so do all rows of an id that stays. Empty tables and
    texts stay as they are."""
    marks = near_duplicates(docs, broadcast_rows=broadcast_rows, **how)
    gone = marks.where("not kept and doc_id is not null").select(F.col("doc_id").alias("__id")).distinct()
    gone = F.broadcast(gone) if gone.count() <= broadcast_rows else gone
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__id"], "left_anti")


def op3_near_dedup(spark, sf_dir):
    """Every document with the size of its shingle set and its component of near-duplicates from 85 % on."""
    return near_duplicates(table(spark, sf_dir, "documents"))
