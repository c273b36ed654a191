"""A hierarchical Pitman-Yor bigram model: context restaurants that share a parent, seated by Gibbs sampling, all in blocks.

Tokens go into blocks with a vocabulary each. Blocks ask the owners of word hashes for counts and word numbers, then the
owners of contexts for the probability of each distinct pair of theirs. An owner seats the customers of its restaurants;
tables are the customers of the parent restaurant, whose dishes are spread over owners by word. A hot context's dishes are
spread over as many owners as its share of the tokens asks for.

A Gibbs sweep draws, each given the rest: an auxiliary number for the root, the tables of all its dishes, the root's shares of
the words (gamma variates whose sum makes them a Dirichlet draw), an auxiliary number for each context and the tables of all
its dishes (see seating.py). Given the root's shares the contexts are independent, so this holds however they are spread. All
customers of all dishes are seated anew in every sweep. One thing is not drawn: of what the root leaves to new tables, each word
gets the expected share.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import Scratch, give_back, shuffle_partitions, table, text_col
from .seating import draw_tables

BLOCK_TOKENS = 1_500_000
END = np.uint64(0xE2D5E2D5E2D5E2D5)
#: Pairs that are worked on at once where each stands for itself, so that intermediate numbers take little memory.
_SLICE = 1 << 18
#: Answers are whole multiples of 1 / FINE: log10 probabilities to 2e-6, whose upper bytes pack well.
FINE = float(1 << 18)


def pack(a: np.ndarray) -> bytes:
    """a compressed. Whole numbers go byte plane by byte plane, as small ones leave the upper planes empty."""
    a = np.ascontiguousarray(a)
    if a.dtype.kind != "f":
        a = a.view(np.uint8).reshape(len(a), a.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def unpack(b: bytes, kind) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(b)
    if np.dtype(kind).kind == "f":
        return np.frombuffer(raw, kind)
    planes = np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and each key's place among them: as np.unique has them, in half its memory."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.empty(len(keys), np.bool_)
    new[:1] = True
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    keys = keys[new]
    place = np.cumsum(new, dtype=np.int32)
    place -= 1
    out = np.empty(len(order), np.int32)
    out[order] = place
    return keys, out


def _owner_edges(values: np.ndarray, owners: int) -> np.ndarray:
    edges = np.array([(k << 64) // owners for k in range(1, owners)], np.uint64)
    return np.concatenate([[0], np.searchsorted(values, edges), [len(values)]])


def _arrow(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _blocks(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("block", pa.int64()), *[(c, pa.binary()) for c in ("docs", "known", "sizes", "train", "vocab", "ids")]])

    def run(batches):
        from pyspark import TaskContext

        at, k, held, n = TaskContext.get().partitionId() << 32, 0, [], 0

        def block():
            vocab, ids = distinct(np.concatenate([x[3] for x in held]))
            # Frequent words get small numbers.
            order = np.argsort(-np.bincount(ids, minlength=len(vocab)), kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order))
            vocab, ids = vocab[order], place[ids]
            row = {"block": at + k, "docs": pack(np.concatenate([x[0] for x in held])), "known": pack(np.concatenate([x[4] for x in held])), "sizes": pack(np.concatenate([x[1] for x in held])), "train": pack(np.concatenate([x[2] for x in held])), "vocab": pack(vocab), "ids": pack(ids)}
            return _arrow([row], schema)

        for batch in batches:
            off, raw = words.buffer_of(batch.column(1))
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            train = batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)
            for i, j in words.slices(off, 2 << 20):
                h, start = words.words(off[i : j + 1] - off[i], raw[off[i] : off[j]])
                h = np.where(h == END, END + np.uint64(1), h)
                held.append((ids[i:j], np.diff(start) + 1, train[i:j], np.insert(h, start[1:], END), known[i:j]))
                n += len(held[-1][3])
                if n >= BLOCK_TOKENS:
                    yield block()
                    k, held, n = k + 1, [], 0
        if held:
            yield block()
        held.clear()
        give_back()

    return docs.mapInArrow(run, "block long, docs binary, known binary, sizes binary, train binary, vocab binary, ids binary")


def _tokens(row):
    """sizes, a training flag for each token, vocabulary, tokens of a block."""
    sizes, train = unpack(row["sizes"], np.int64), unpack(row["train"], np.uint8)
    return sizes, np.repeat(train, sizes).astype(bool), unpack(row["vocab"], np.uint64), unpack(row["ids"], np.int32)


def _word_owners(blocks: DataFrame, owners: int) -> DataFrame:
    """block, owner, counts, numbers for the block's words in that owner's range; types and tokens once for an owner."""
    schema = pa.schema([("owner", pa.int32()), ("block", pa.int64()), ("vocab", pa.binary()), ("counts", pa.binary())])

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                _, train, vocab, ids = _tokens(row)
                order = np.argsort(vocab)
                vocab, c = vocab[order], np.bincount(ids[train], minlength=len(vocab))[order]
                at = _owner_edges(vocab, owners)
                yield _arrow([{"owner": o, "block": row["block"], "vocab": pack(vocab[i:j]), "counts": pack(c[i:j])} for o, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if j > i], schema)

    def answer(key, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(x, np.uint64) for x in pdf["vocab"]]
        vocab, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([unpack(x, np.int64) for x in pdf["counts"]]), len(vocab)).astype(np.int64)
        number = np.empty(len(vocab), np.int64)
        number[np.argsort(-total, kind="stable")] = np.arange(len(vocab)) * owners + key[0]
        cut = np.cumsum([len(p) for p in parts])[:-1]
        first = np.arange(len(parts)) == 0
        return pd.DataFrame({"block": pdf["block"], "owner": key[0], "counts": [pack(x) for x in np.split(total[inverse], cut)], "numbers": [pack(x) for x in np.split(number[inverse], cut)], "types": np.where(first, (total > 0).sum(), 0), "tokens": np.where(first, total.sum(), 0)})

    asked = blocks.select("block", "sizes", "train", "vocab", "ids").mapInArrow(ask, "owner int, block long, vocab binary, counts binary")
    return asked.groupBy("owner").applyInPandas(answer, "block long, owner int, counts binary, numbers binary, types long, tokens long")


def _pairs(row, told: pd.DataFrame, n_tokens: int, buckets: int, answered: bool) -> dict:
    """A block's counts and numbers by word, and its distinct pairs in order of their owners: before they are answered the words
    of each, its count in training and where owners begin, afterwards each token's pair."""
    sizes, train, vocab, ids = _tokens(row)
    told = told.sort_values("owner")
    by_hash, counts, number = np.argsort(vocab), np.empty(len(vocab), np.int64), np.empty(len(vocab), np.int64)
    counts[by_hash] = np.concatenate([unpack(x, np.int64) for x in told["counts"]])
    number[by_hash] = np.concatenate([unpack(x, np.int64) for x in told["numbers"]])
    before = np.empty(len(ids), np.int64)
    before[0], before[1:] = np.flatnonzero(vocab == END)[0], ids[:-1]
    before <<= 32
    before |= ids
    keys, inverse = distinct(before)
    del before
    seen = None if answered else np.bincount(inverse[train], minlength=len(keys)).astype(np.int32)
    if not answered:
        del inverse, ids
    # A hot context has so many pieces that each holds about 1/(4 * buckets) of all tokens at most.
    pieces = np.maximum(-(-counts * 4 * buckets // max(n_tokens, 1)), 1).astype(np.uint64)
    mixed, bucket = words.mix(number.astype(np.uint64)), np.empty(len(keys), np.int32)
    for i in range(0, len(keys), _SLICE):
        u, w = keys[i : i + _SLICE] >> 32, keys[i : i + _SLICE] & 0xFFFFFFFF
        with np.errstate(over="ignore"):
            bucket[i : i + _SLICE] = words.mix(number[u].astype(np.uint64) + mixed[w] % pieces[u] * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable").astype(np.int32)
    if answered:
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        return {"sizes": sizes, "ids": ids, "counts": counts, "pair": rank[inverse]}
    at = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])
    del bucket
    keys = keys[order]
    return {"counts": counts, "number": number, "hot": pieces > 1, "u": (keys >> 32).astype(np.int32), "w": keys.astype(np.int32), "c": seen[order], "at": at}


def root_shares(c: np.ndarray, lam: float, d: float, rng) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of the root's dishes, what these leave of their customers, and gamma variates of that."""
    t = draw_tables(c, np.full(len(c), lam), d, rng)
    rest = c - d * t
    return t, rest, rng.standard_gamma(rest)


def seat_contexts(c: np.ndarray, u: np.ndarray, parent: np.ndarray, aux: np.ndarray, d: float, rng) -> np.ndarray:
    """Tables of each (context, dish): c customers in context u, aux by context, parent the root's drawn share of the dish."""
    lam = aux[u]
    lam *= parent
    return draw_tables(c, lam, d, rng)


def predictive(c: np.ndarray, t: np.ndarray, u: np.ndarray, tables: np.ndarray, customers: np.ndarray, parent: np.ndarray, d: float, strength: float) -> np.ndarray:
    """The probability of each (context, dish) under a seating."""
    return (c - d * t + (strength + d * tables[u]) * parent) / (strength + customers[u])


_STATE = "bucket int, ulist binary, cu binary, hot binary, wlist binary, pu binary, pw binary, c binary, t binary, total binary, tables long, hot_u array<long>, hot_t array<long>"


def _column(pdf: pd.DataFrame, name: str, kind) -> np.ndarray:
    return np.concatenate([unpack(x, kind) for x in pdf[name]])


def _gather(pdf: pd.DataFrame) -> dict:
    """A bucket's contexts, words and distinct pairs out of the blocks' parts, where u comes once a run of n pairs."""
    ulist, first, of = np.unique(_column(pdf, "u", np.int64), return_index=True, return_inverse=True)
    wlist, keys = distinct(_column(pdf, "w", np.int64))
    keys = keys.astype(np.int64)
    keys |= (of << 32).repeat(_column(pdf, "n", np.int32))
    keys, inverse = distinct(keys)
    return {"ulist": ulist, "first": first, "wlist": wlist, "keys": keys, "inverse": inverse}


def score_documents(docs: DataFrame, text: str = "text", d: float = 0.8, strength: float = 20.0, root_d: float = 0.5, root_strength: float = 10.0, burn_in: int = 2, samples: int = 2, seed: int = 7, buckets: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row of docs.

    Texts are lower-cased (A-Z), cut into words and closed by one end token, which is also the context of a text's first
    word. Rows whose crc32 of doc_id modulo 7 is 2 are held out of training. score is the log10 probability of the text,
    each token's probability averaged over the `samples` seatings that follow `burn_in` sweeps, a sweep apart; perplexity is
    that of the text by token. A sweep seats all customers of every dish of every restaurant anew; all counts are used.

    Null and empty texts are one end token. A row without doc_id is trained on and its doc_id stays null. Repeated rows are
    trained on and scored each. With no training rows every token is unknown (N = V = 0). An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "hpy")
    out_rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_col(docs, text).alias("text"), (F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 != 2).alias("train"))
    blocks = scratch.write(_blocks(out_rows.select("doc_id", "text", F.coalesce("train", F.lit(True)).alias("train"))), "blocks")
    owners = buckets = buckets or max(shuffle_partitions(spark), blocks.count() // 2)
    told = scratch.write(_word_owners(blocks, owners), "words")
    types, tokens = (int(x or 0) for x in told.agg(F.sum("types"), F.sum("tokens")).first())
    told = told.select("block", "owner", "counts", "numbers")
    floor = 1.0 / (types + 1)

    def ask(key, mine: pd.DataFrame, words_of: pd.DataFrame) -> pd.DataFrame:
        p = _pairs(mine.iloc[0], words_of, tokens, buckets, answered=False)
        give_back()
        rows = []
        for k, (i, j) in enumerate(zip(p["at"][:-1], p["at"][1:], strict=True)):
            if j > i:  # pairs of one context stand together
                runs = i + np.concatenate([[0], np.flatnonzero(np.diff(p["u"][i:j])) + 1])
                u = p["u"][runs]
                rows.append((k, key[0], pack(p["number"][u]), pack(np.diff(runs, append=j).astype(np.int32)), pack(p["number"][p["w"][i:j]]), pack(p["c"][i:j].astype(np.int64)), pack(p["counts"][u]), pack(p["hot"][u])))
        return pd.DataFrame(rows, columns=["bucket", "block", "u", "n", "w", "c", "cu", "hot"])

    small = blocks.select("block", "sizes", "train", "vocab", "ids")
    asked = scratch.write(small.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(ask, "bucket int, block long, u binary, n binary, w binary, c binary, cu binary, hot binary"), "pairs")

    def begin(key, pdf: pd.DataFrame) -> pd.DataFrame:
        g = _gather(pdf)
        c = np.bincount(g["inverse"], _column(pdf, "c", np.int64), len(g["keys"])).astype(np.int64)
        per_u = np.bincount(g["keys"] >> 32, minlength=len(g["ulist"])).astype(np.int32)
        row = {"bucket": key[0], "ulist": g["ulist"], "cu": _column(pdf, "cu", np.int64)[g["first"]], "hot": _column(pdf, "hot", np.uint8)[g["first"]], "wlist": g["wlist"], "pu": per_u, "pw": (g["keys"] & 0xFFFFFFFF).astype(np.int32), "c": c, "t": (c > 0).astype(np.int32), "total": np.zeros(0, np.float32)}
        at_hot = row["hot"].astype(bool)
        hot_t = np.bincount(g["keys"] >> 32, c > 0, len(g["ulist"]))[at_hot].astype(np.int64)
        return pd.DataFrame([{k: v if k == "bucket" else pack(v) for k, v in row.items()} | {"tables": int((c > 0).sum()), "hot_u": g["ulist"][at_hot].tolist(), "hot_t": hot_t.tolist()}])

    state = scratch.write(asked.groupBy("bucket").applyInPandas(begin, _STATE), "state")

    def parents(state: DataFrame, sweep: int, root_aux: float) -> DataFrame:
        """bucket, owner, rest, share, root_tables, mass: what the root's tables leave to each of a bucket's words, and the drawn
        shares; the sums of tables and shares stand in one row for an owner."""

        def ask_parent(batches):
            schema = pa.schema([("owner", pa.int32()), ("bucket", pa.int32()), ("w", pa.binary()), ("t", pa.binary())])
            for batch in batches:
                for row in batch.to_pylist():
                    wlist = unpack(row["wlist"], np.int64)
                    tables = np.bincount(unpack(row["pw"], np.int32), unpack(row["t"], np.int32), len(wlist)).astype(np.int64)
                    order = np.argsort(wlist % owners, kind="stable")
                    wlist, tables = wlist[order], tables[order]
                    at = np.concatenate([[0], np.flatnonzero(np.diff(wlist % owners)) + 1, [len(wlist)]])
                    rows = [{"owner": int(wlist[i] % owners), "bucket": row["bucket"], "w": pack(wlist[i:j]), "t": pack(tables[i:j])} for i, j in zip(at[:-1], at[1:], strict=True) if j > i]
                    yield _arrow(rows, schema)

        def answer(key, pdf: pd.DataFrame) -> pd.DataFrame:
            rng = np.random.default_rng([seed, sweep, key[0], 1])
            parts = [unpack(x, np.int64) for x in pdf["w"]]
            w, inverse = np.unique(np.concatenate(parts), return_inverse=True)
            c = np.bincount(inverse, np.concatenate([unpack(x, np.int64) for x in pdf["t"]]), len(w)).astype(np.int64)
            t, rest, share = root_shares(c, root_aux * floor, root_d, rng)
            cut = np.cumsum([len(p) for p in parts])[:-1]
            first = np.arange(len(parts)) == 0
            return pd.DataFrame({"bucket": pdf["bucket"], "owner": key[0], "rest": [pack(x) for x in np.split(rest.astype(np.float32)[inverse], cut)], "share": [pack(x) for x in np.split(share.astype(np.float32)[inverse], cut)], "root_tables": np.where(first, t.sum(), 0), "mass": np.where(first, share.sum(), 0.0)})

        asked = state.select("bucket", "wlist", "pw", "t").mapInArrow(ask_parent, "owner int, bucket int, w binary, t binary")
        return asked.groupBy("owner").applyInPandas(answer, "bucket int, owner int, rest binary, share binary, root_tables long, mass double")

    def hot_sums(state: DataFrame) -> DataFrame:
        """bucket, hot_u, hot_t: the tables of each hot context that has a piece in the bucket, over all its pieces."""
        held = state.select("bucket", F.explode(F.arrays_zip("hot_u", "hot_t")).alias("x")).select("bucket", F.col("x.hot_u").alias("u"), F.col("x.hot_t").alias("t"))
        whole = held.groupBy("u").agg(F.sum("t").alias("t")).withColumnRenamed("u", "wu")
        each = held.drop("t").join(whole, held["u"] == whole["wu"])
        return each.groupBy("bucket").agg(F.collect_list("u").alias("hot_u"), F.collect_list("t").alias("hot_t"))

    def sweep_of(sweep: int, root: dict, count: bool, last: bool):
        def run(key, mine: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
            row, rng = mine.iloc[0], np.random.default_rng([seed, sweep, key[0]])
            ulist, cu, wlist = unpack(row["ulist"], np.int64), unpack(row["cu"], np.int64), unpack(row["wlist"], np.int64)
            pu, pw, c, hot = np.arange(len(ulist), dtype=np.int32).repeat(unpack(row["pu"], np.int32)), unpack(row["pw"], np.int32), unpack(row["c"], np.int64), unpack(row["hot"], np.uint8).astype(bool)
            t = unpack(row["t"], np.int32).astype(np.int64)
            rest, share, by_owner = np.empty(len(wlist)), np.empty(len(wlist)), np.argsort(wlist % owners, kind="stable")
            said = told[told["owner"] >= 0].sort_values("owner")
            rest[by_owner] = np.concatenate([unpack(x, np.float32) for x in said["rest"]])
            share[by_owner] = np.concatenate([unpack(x, np.float32) for x in said["share"]])
            tables = np.bincount(pu, t, len(ulist))
            if hot.any():
                sums = told[told["owner"] < 0].iloc[0]
                whole = dict(zip(sums["hot_u"], sums["hot_t"], strict=True))
                tables[hot] = [whole[u] for u in ulist[hot].tolist()]
            total = unpack(row["total"], np.float32)
            if count:  # of the seating as it is: its tables are the customers that the root answered for
                parent = (rest + (root_strength + root_d * root["tables"]) * floor) / (root_strength + root["customers"])
                total = total.copy() if len(total) else np.zeros(len(c), np.float32)
                for i in range(0, len(c), _SLICE):
                    k = slice(i, i + _SLICE)
                    total[k] += predictive(c[k], t[k], pu[k], tables, cu, parent[pw[k]], d, strength).astype(np.float32)
            if not last:
                aux = rng.standard_gamma(strength / d + tables)
                # All pieces of a context have one number.
                aux[hot] = [np.random.default_rng([seed, sweep, u, 2]).standard_gamma(strength / d + x) for u, x in zip(ulist[hot].tolist(), tables[hot].tolist(), strict=True)]
                t = seat_contexts(c, pu, ((share + root["rest"] * floor) / (root["mass"] + root["rest"]))[pw], aux, d, rng)
            local = np.bincount(pu, t, len(ulist)).astype(np.int64)
            # After the last sweep only the sums of probabilities are asked for.
            kept = {k: b"" if last else row[k] for k in ("ulist", "cu", "hot", "wlist", "pu", "pw", "c")}
            out = kept | {"bucket": key[0], "t": b"" if last else pack(t.astype(np.int32)), "total": pack(total), "tables": int(t.sum()), "hot_u": ulist[hot].tolist(), "hot_t": local[hot].tolist()}
            give_back()
            return pd.DataFrame([out])

        return run

    chain, root_tables = np.random.default_rng([seed, 3]), types
    for sweep in range(burn_in + samples):
        customers = int(state.agg(F.sum("tables")).first()[0] or 0)
        up = scratch.write(parents(state, sweep, float(chain.standard_gamma(root_strength / root_d + root_tables))), "parents")
        root_tables, mass = (x or 0 for x in up.agg(F.sum("root_tables"), F.sum("mass")).first())
        root = {"tables": root_tables, "customers": customers, "mass": mass, "rest": float(chain.standard_gamma(root_strength + root_d * root_tables))}
        last = sweep + 1 == burn_in + samples
        none, counts = F.lit(None).cast("binary"), F.lit(None).cast("array<long>")
        told_of = up.select("bucket", "owner", "rest", "share", counts.alias("hot_u"), counts.alias("hot_t")).unionByName(hot_sums(state).select("bucket", F.lit(-1).alias("owner"), none.alias("rest"), none.alias("share"), "hot_u", "hot_t"))
        after = scratch.write(state.groupBy("bucket").cogroup(told_of.groupBy("bucket")).applyInPandas(sweep_of(sweep, root, sweep >= burn_in, last), _STATE), "state")
        scratch.drop_table(state)
        scratch.drop_table(up)
        state = after

    def reply(key, pairs: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        g, total = _gather(pairs), unpack(mine.iloc[0]["total"], np.float32)
        logp = np.rint(-FINE * np.log10(np.maximum(total.astype(np.float64) / samples, 1e-37))).astype(np.int32)
        cut = np.cumsum([int(unpack(x, np.int32).sum()) for x in pairs["n"]])[:-1]
        return pd.DataFrame({"block": pairs["block"], "owner": key[0], "logp": [pack(x) for x in np.split(logp[g["inverse"]], cut)]})

    replies = asked.select("bucket", "block", "u", "n", "w").groupBy("bucket").cogroup(state.select("bucket", "total").groupBy("bucket")).applyInPandas(reply, "block long, owner int, logp binary")
    # The answers as a table: the pairs and the state are done with then.
    replies = scratch.write(replies, "replies")
    scratch.drop_table(asked)
    scratch.drop_table(state)
    empty = F.lit(None).cast("binary")
    both = told.select("block", "owner", "counts", "numbers", empty.alias("logp")).unionByName(replies.select("block", "owner", empty.alias("counts"), empty.alias("numbers"), "logp"))

    def finish(key, mine: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        row, said = mine.iloc[0], got["logp"].notna()
        p = _pairs(row, got[~said], tokens, buckets, answered=True)
        logp = np.concatenate([unpack(x, np.int32) for x in got[said].sort_values("owner")["logp"]]) / -FINE
        first = np.cumsum(p["sizes"]) - p["sizes"]
        base = np.log10((p["counts"] + 1) / (tokens + types + 1))
        score = np.add.reduceat(logp[p["pair"]], first)
        give_back()
        doc_id = pd.arrays.IntegerArray(unpack(row["docs"], np.int64).copy(), unpack(row["known"], np.uint8) == 0)
        return pd.DataFrame({"doc_id": doc_id, "held_out": unpack(row["train"], np.uint8) == 0, "n_tokens": p["sizes"], "n_known": np.add.reduceat((p["counts"] > 0)[p["ids"]].astype(np.int64), first), "train_tokens": tokens, "base_score": np.add.reduceat(base[p["ids"]], first), "score": score, "perplexity": 10 ** np.minimum(-score / p["sizes"], 300)})

    out = blocks.groupBy("block").cogroup(both.groupBy("block")).applyInPandas(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
    return scratch.tied_to(out)


def op1_pitman_yor(spark, sf_dir):
    """Every document with its log10 probability under the model and under smoothed word counts."""
    return score_documents(table(spark, sf_dir, "documents"))
