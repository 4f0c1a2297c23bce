"""Repair of the structure of conversations by the cheapest edits, with a square-root checkpointed dynamic programme.

The role initials of a conversation must come out as ``(s?(ua)+)?``. Rows are taken in order of turn; keeping one costs 0,
giving it the role user or assistant 2, deleting it 3, inserting an empty turn of user or assistant 2; a row that is not
deleted although its text breaks off costs 1 more; blank rows and repeats must be deleted. The pattern has four states,
so what the rest of a conversation costs is a vector of four numbers, got from the vector after it by one row's 4 x 4
matrix of costs.

A conversation is cut in blocks of rows, and a block is one row of a table: its rows, one code each, and the product of their
matrices. From these products alone the vector at the end of every block follows; then a block is walked from each state in
which it may be entered: backward once, keeping a vector at every sqrt(rows)-th row only, then forward, with the vectors
between two kept ones computed again, taking at each step the tight edit whose letter comes first (Delete, Insert, Keep,
Rerole). Which entry is the real one follows from the states in which the walks end. So a conversation may hold any share of
all rows: only four numbers a block, never its rows, meet in one place. Rows are put in order by a range partitioning that
cuts conversations; equal rows are counted first and are one row with a number, so a row repeated any number of times is
one code.

Defined cases: a null text is blank; a null conv_id is a conversation, null turns come first, a null or empty role, or one that
begins with another letter than s, u or a, can be deleted or get a new role only; rows of one turn are in order of role, then of
the SHA-256 of their text (nulls first); equal rows (role and text) in one conversation are repeats wherever they stand;
texts of any length are taken whole, but compared by SHA-256; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import cut

SPACES = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
BIG = 1 << 40

#: Codes: 0 must be deleted, 1 + 2 * initial (s, u, a, other) + truncated, PAD stands for no row.
MUST_DELETE, PAD = 0, 9
INITIALS = "sua"
#: The state after a turn of the initial, by the state before.
KEEP_TO = np.array([[SYSTEM, -1, -1, -1], [USER, USER, -1, USER], [-1, -1, ASSISTANT, -1], [-1, -1, -1, -1]])
#: The state after an inserted or reroled turn; its role follows from the state.
FORCED = np.array([USER, USER, ASSISTANT, USER])
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
#: Cost of ending in each state, and the turns inserted for it.
END = np.array([0, 4, 2, 0])
TAIL = ("", "II", "I", "")


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least sums over the state between, for matrices [..., 4, 4]."""
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(axis=-2), BIG)


def _matrices() -> np.ndarray:
    insert = np.full((4, 4), BIG)
    insert[range(4), range(4)] = 0
    once = insert.copy()
    once[range(4), FORCED] = 2
    inserts = _product(_product(once, once), once)
    m = np.full((10, 4, 4), BIG)
    m[PAD] = insert
    for code in range(9):
        m[code, range(4), range(4)] = 3
        if code != MUST_DELETE:
            initial, broken = divmod(code - 1, 2)
            for s in range(4):
                m[code, s, FORCED[s]] = 2 + broken
            for s in range(4):
                if KEEP_TO[initial, s] >= 0:
                    m[code, s, KEEP_TO[initial, s]] = min(m[code, s, KEEP_TO[initial, s]], broken)
        m[code] = _product(inserts, m[code])
    return m


STEP = _matrices()


def _groups(codes: list[bytes], most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers, codes as a matrix) of blocks of like length; shorter ones are padded in front."""
    order = sorted(range(len(codes)), key=lambda i: len(codes[i]))
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and len(codes[order[b]]) <= 2 * len(codes[order[a]]) + 4 and (b - a + 1) * len(codes[order[b]]) <= most:
            b += 1
        width = len(codes[order[b - 1]])
        rows = b"".join(codes[i].rjust(width, bytes([PAD])) for i in order[a:b])
        yield np.array(order[a:b]), np.frombuffer(rows, np.uint8).reshape(b - a, width)
        a = b


def transfers(codes: list[bytes]) -> np.ndarray:
    """For each block the costs from every state to every state, as [n, 4, 4]."""
    out = np.empty((len(codes), 4, 4), np.int64)
    for which, c in _groups(codes):
        p = np.broadcast_to(STEP[PAD], (len(which), 4, 4))
        for j in range(c.shape[1] - 1, -1, -1):
            p = _product(STEP[c[:, j]], p)
        out[which] = p
    return out


def _back(c: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.minimum((STEP[c] + v[:, None, :]).min(axis=-1), BIG)


def walks(codes: list[bytes], ends: np.ndarray, entries: np.ndarray) -> tuple[list[tuple[bytes, bytes]], np.ndarray]:
    """For each block (letters of its rows, number of turns inserted before each), and the state it is left in.

    ``ends`` are the vectors after the blocks, ``entries`` the states in which they are entered.
    """
    found: list[tuple[bytes, bytes]] = [(b"", b"")] * len(codes)
    leave = entries.copy()
    for which, c in _groups(codes):
        n, width = c.shape
        stride = max(1, int(np.ceil(np.sqrt(width))))
        kept = {width: ends[which]}
        v = ends[which]
        for j in range(width - 1, -1, -1):
            v = _back(c[:, j], v)
            if j % stride == 0:
                kept[j] = v
        state, each = entries[which], np.arange(n)
        letters, before = np.zeros((n, width), np.uint8), np.zeros((n, width), np.uint8)
        for first in range(0, width, stride):
            last = min(first + stride, width)
            between = [kept[last]]
            for j in range(last - 1, first - 1, -1):
                between.append(_back(c[:, j], between[-1]))
            for j in range(first, last):
                v, after = between[last - j], between[last - j - 1]
                open_ = np.flatnonzero(c[:, j] != PAD)
                while len(open_):
                    s, code = state[open_], c[open_, j].astype(int)
                    due = v[open_, s]
                    initial, broken = (np.maximum(code, 1) - 1) // 2, (np.maximum(code, 1) - 1) % 2
                    keep_to = KEEP_TO[initial, s]
                    delete = 3 + after[open_, s] == due
                    insert = ~delete & (2 + v[open_, FORCED[s]] == due)
                    keep = ~delete & ~insert & (code != MUST_DELETE) & (keep_to >= 0) & (broken + after[open_, np.maximum(keep_to, 0)] == due)
                    before[open_[insert], j] += 1
                    letters[open_, j] = np.where(delete, ord("D"), np.where(keep, ord("K"), ord("R")))
                    state[open_] = np.where(delete, s, np.where(keep, keep_to, FORCED[s]))
                    open_ = open_[insert]
        leave[which] = state
        for i, k in zip(which.tolist(), each.tolist()):
            size = len(codes[i])
            found[i] = letters[k, width - size :].tobytes(), before[k, width - size :].tobytes()
    return found, leave


# --- the tables ----------------------------------------------------------------------------------------
_LIGHT = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text_key", pa.string()), ("copies", pa.int64())])
_BLOCK = (
    "conv_id long, part int, block long, codes binary, rows array<struct<turn:long,role:string,text_key:string,copies:long>>,"
    " blank long, duplicate long, truncated long, illegal long, again long, turns long, low long, high long, first string, last string, matrix array<long>"
)
_STATS = ("blank", "duplicate", "truncated", "illegal", "again", "turns", "low", "high", "first", "last", "matrix")


def _describe(conv: int | None, part: int, block: int, rows: list[dict]) -> dict:
    codes, seen = bytearray(), {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "again": 0, "turns": 0}
    low = high = last = None
    for r in rows:
        copies, end = r["copies"], r["end"] or ""
        initial = (r["role"] or "")[:1]
        broken = end not in ".!?"
        if not end:
            codes.append(MUST_DELETE)
            seen["blank"] += copies
        else:
            seen["duplicate"] += copies - r["is_first"]
            seen["truncated"] += r["is_first"] and broken
            codes.append(1 + 2 * (INITIALS.index(initial) if initial and initial in INITIALS else 3) + broken if r["is_first"] else MUST_DELETE)
        seen["again"] += copies - 1
        seen["illegal"] += copies - 1 + (last is not None and last + initial not in LEGAL)
        last = initial
        if r["turn"] is not None:
            seen["turns"] += r["turn"] != high
            low, high = r["turn"] if low is None else low, r["turn"]
    light = [{k: r[k] for k in ("turn", "role", "text_key", "copies")} for r in rows]
    return {"conv_id": conv, "part": part, "block": block, "codes": bytes(codes), "rows": light, "low": low, "high": high, "first": (rows[0]["role"] or "")[:1], "last": last} | seen


def _pack(most: int):
    schema = pa.schema(
        [("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int64()), ("codes", pa.binary()), ("rows", pa.list_(_LIGHT))]
        + [(k, pa.int64()) for k in _STATS[:8]] + [("first", pa.string()), ("last", pa.string()), ("matrix", pa.list_(pa.int64()))]
    )

    def batch(blocks: list[dict]) -> pa.RecordBatch:
        for b, m in zip(blocks, transfers([b["codes"] for b in blocks])):
            b["matrix"] = m.ravel().tolist()
        return pa.RecordBatch.from_pylist(blocks, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, rows, done, block, part, held = None, [], [], 0, 0, 0
        for b in batches:
            for r in b.to_pylist():
                part = r["part"]
                if rows and (r["conv_id"] != conv or len(rows) >= most):
                    done.append(_describe(conv, part, block, rows))
                    held, block, rows = held + len(rows), block + 1, []
                    if held >= 8 * most:
                        yield batch(done)
                        done, held = [], 0
                conv = r["conv_id"]
                rows.append(r)
        if rows:
            done.append(_describe(conv, part, block, rows))
        if done:
            yield batch(done)

    return run


def _row_table(turns: DataFrame) -> DataFrame:
    """Every different row once, with its number of copies, the last character of its text and whether it is the first of its kind."""
    end = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    key = F.sha2(F.col("text").cast("binary"), 256)
    light = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", key.alias("text_key"), end.alias("end"))
    rows = cut(light.groupBy("conv_id", "turn", "role", "text_key", "end").agg(F.count(F.lit(1)).alias("copies")))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    kind = rows.groupBy("conv_id", "role", "text_key").agg(F.min(place).alias("at")).toDF("k_conv", "k_role", "k_text", "at")
    same = F.col("conv_id").eqNullSafe(F.col("k_conv")) & F.col("role").eqNullSafe(F.col("k_role")) & F.col("text_key").eqNullSafe(F.col("k_text"))
    is_first = (F.col("at") == place) | (F.col("at.turn").isNull() & F.col("turn").isNull())
    return rows.join(kind, same).select("conv_id", "turn", "role", "text_key", "end", "copies", F.coalesce(is_first, F.lit(False)).cast("int").alias("is_first"))


def _conversation(blocks: list[dict]) -> tuple[dict, list[np.ndarray]]:
    """The figures of a conversation, and the vector at the end of each of its blocks."""
    ends, v = [END], END
    for b in blocks[:0:-1]:
        v = np.minimum((np.array(b["matrix"]).reshape(4, 4) + v).min(axis=1), BIG)
        ends.append(v)
    ends.reverse()
    v = (np.array(blocks[0]["matrix"]).reshape(4, 4) + ends[0]).min(axis=1)
    out = {k: sum(b[k] for b in blocks) for k in ("blank", "duplicate", "truncated", "illegal", "again", "turns")}
    high = low = None
    for a, b in zip([None, *blocks], blocks):
        out["illegal"] += a is not None and a["last"] + b["first"] not in LEGAL
        if b["low"] is not None:
            out["turns"] -= b["low"] == high
            low, high = b["low"] if low is None else low, b["high"]
    out["cost"] = int(v[START]) + 3 * out.pop("again")
    distinct = out.pop("turns")
    out["gaps"] = 0 if low is None else high - low + 1 - distinct
    return out, ends


_FIGURES = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block: its end vector, and on the first block of a conversation the figures of the whole."""
    names = [f.split()[0] for f in _FIGURES.split(", ")]
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int64()), ("ends", pa.list_(pa.int64())), ("number", pa.int64()), ("of", pa.int64())] + [(n, pa.int64()) for n in names])
    for b in batches:
        rows = []
        for r in b.to_pylist():
            figures, ends = _conversation(r["blocks"])
            for i, (x, e) in enumerate(zip(r["blocks"], ends)):
                rows.append({"conv_id": r["conv_id"], "part": x["part"], "block": x["block"], "ends": e.tolist(), "number": i, "of": len(ends)} | (figures if i == 0 else {}))
        yield pa.RecordBatch.from_pylist(rows, schema)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every block walked from each state in which it may be entered (a first block from the start)."""
    for b in batches:
        pairs = [(i, s) for i, k in enumerate(b.column("number").to_pylist()) for s in (range(4) if k else (START,))]
        codes, ends = b.column("codes").to_pylist(), np.array(b.column("ends").to_pylist(), np.int64).reshape(-1, 4)
        of = np.array([i for i, _ in pairs], int)
        found, leave = walks([codes[i] for i in of], ends[of], np.array([s for _, s in pairs], int))
        take = b.take(pa.array(of))
        yield pa.RecordBatch.from_arrays(
            [*(take.column(n) for n in ("conv_id", "part", "block", "number", "of", "rows")), pa.array([s for _, s in pairs], pa.int32()), pa.array(leave, pa.int32()),
             pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())],
            names=["conv_id", "part", "block", "number", "of", "rows", "entry", "leave", "letters", "inserts"],
        )


def _entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each block is really entered."""
    for b in batches:
        rows = []
        for walks_of in b.column("walks").to_pylist():
            to = {(w["number"], w["entry"]): w for w in walks_of}
            state = START
            for number in range(1 + max(n for n, _ in to)):
                w = to[number, state]
                rows.append({"part": w["part"], "block": w["block"], "entry": state})
                state = w["leave"]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int32()), ("block", pa.int64()), ("entry", pa.int32())]))


_EDIT = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int64()), ("step", pa.int64()), ("edit", pa.string()), ("times", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text_key", pa.string())]
)


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row an edit (and one for the further copies of a row, which go)."""
    for b in batches:
        rows: list[tuple] = []
        for r in b.to_pylist():
            state, at = r["entry"], (r["conv_id"], r["part"], r["block"])
            own: list[tuple] = []

            def forced() -> str:
                nonlocal state
                state = int(FORCED[state])
                return ROLES[state]

            for row, letter, inserts in zip(r["rows"], r["letters"].decode(), r["inserts"]):
                own += [("I", 1, None, forced(), None) for _ in range(inserts)]
                if letter == "D":
                    own.append(("D", row["copies"], row["turn"], None, row["text_key"]))
                    continue
                if letter == "K":
                    role, state = row["role"], int(KEEP_TO[INITIALS.index(row["role"][:1]), state])
                else:
                    role = forced()
                own.append((letter, 1, row["turn"], role, row["text_key"]))
                if row["copies"] > 1:
                    own.append(("D", row["copies"] - 1, row["turn"], None, row["text_key"]))
            if r["number"] == r["of"] - 1:
                own += [(x, 1, None, forced(), None) for x in TAIL[state]]
            rows += [(*at, i, *x) for i, x in enumerate(own)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_EDIT)], schema=_EDIT)


def repair(turns: DataFrame, block: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(edits, figures) of ``turns(conv_id, turn, role, text)``.

    edits: conv_id, part, block, step (these three give the order), edit (K, R, D, I), times (more than 1 for copies that are
    deleted together), turn, role and text of the turn that stays (an inserted one has an empty text, a deleted one neither).
    figures: conv_id, gaps, blank, duplicate, truncated, illegal, cost for every conversation.
    """
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text_key")]
    rows = _row_table(turns).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    blocks = cut(rows.mapInArrow(_pack(block), _BLOCK))
    light = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "block", *_STATS))).alias("blocks"))
    ends = cut(light.mapInArrow(_backward, f"conv_id long, part int, block long, ends array<long>, number long, of long, {_FIGURES}"))
    found = cut(
        blocks.select("conv_id", "part", "block", "codes", "rows").join(ends.select("part", "block", "ends", "number", "of"), ["part", "block"])
        .mapInArrow(_walked, "conv_id long, part int, block long, number long, of long, rows array<struct<turn:long,role:string,text_key:string,copies:long>>, entry int, leave int, letters binary, inserts binary")
    )
    several = found.where("of > 1").groupBy("conv_id").agg(F.collect_list(F.struct("number", "entry", "part", "block", "leave")).alias("walks"))
    entered = several.mapInArrow(_entered, "part int, block long, entry int")
    real = found.where("of = 1").unionByName(found.where("of > 1").join(entered, ["part", "block", "entry"], "left_semi").select(*found.columns))
    edits = real.mapInArrow(_spelled, "conv_id long, part int, block long, step long, edit string, times long, turn long, role string, text_key string")
    key = F.sha2(F.col("text").cast("binary"), 256)
    texts = turns.where("text is not null").select(F.col("conv_id").cast("long").alias("t_conv"), key.alias("t_key"), "text").groupBy("t_conv", "t_key").agg(F.first("text").alias("text"))
    same = F.col("conv_id").eqNullSafe(F.col("t_conv")) & (F.col("text_key") == F.col("t_key"))  # a common text is not one key
    stays = edits.where("edit in ('K', 'R')").join(texts, same, "left")
    plain = edits.where("edit in ('D', 'I')").withColumn("text", F.when(F.col("edit") == "I", ""))
    columns = ["conv_id", "part", "block", "step", "edit", "times", "turn", "role", "text"]
    return stays.select(*columns).unionByName(plain.select(*columns)), ends.where("number = 0").select("conv_id", *(f.split()[0] for f in _FIGURES.split(", ")))


# --- the query -----------------------------------------------------------------------------------------
def damage(turns: DataFrame) -> DataFrame:
    """Rows damaged by h = crc32("conv_id:turn") % 20, nulls being one space: 0 drops the row, 1 empties its text, 2 takes its ``.!?`` out, 3 repeats it, 4 makes it a user's."""

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("long").cast("string"), F.lit(" "))

    h = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = turns.where(h != 0).select("conv_id", "turn", F.when(h == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(h == 3, 2).otherwise(1).alias("copies"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("col")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, audit, repaired_sha256 of rows that come in order; a conversation's texts pass through one by one."""
    schema = pa.schema([("conv_id", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    conv: tuple = ()
    audit: list[str] = []
    digest, lines = hashlib.sha256(), 0
    for b in batches:
        done = []
        for c, edit, times, role, text in zip(*(b.column(n).to_pylist() for n in ("conv_id", "edit", "times", "role", "text"))):
            if conv != (c,):
                if conv:
                    done.append({"conv_id": conv[0], "audit": "".join(audit), "repaired_sha256": digest.hexdigest()})
                conv, audit, digest, lines = (c,), [], hashlib.sha256(), 0
            audit.append(edit * times)
            if edit != "D":
                digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                lines += 1
        yield pa.RecordBatch.from_pylist(done, schema)
    if conv:
        yield pa.RecordBatch.from_pylist([{"conv_id": conv[0], "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], schema)


def repair_digest(conversations: DataFrame, block: int = 4096) -> DataFrame:
    """One row for every conv_id of ``conversations``: figures, audit and digest of what the damaged rows are repaired to.

    A SHA-256 has no parallel form, so the lines of one conversation pass through one task, in order and one after the other.
    """
    edits, figures = repair(damage(conversations), block)
    sent = edits.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "part", "block", "step")
    digests = sent.mapInArrow(_digest, "conv_id long, audit string, repaired_sha256 string").withColumnRenamed("conv_id", "d_conv")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    f = figures.withColumnRenamed("conv_id", "f_conv")
    found = ids.join(f, F.col("conv_id").eqNullSafe(F.col("f_conv")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("d_conv")), "left")
    numbers = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
