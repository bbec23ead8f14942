"""Conversation structure repair by iterative-deepening A*.

The turns of a conversation are kept (K), given another role (R), deleted (D)
or preceded by inserted empty turns (I) so that the initials of the roles read
``(s?(ua)+)?``, at the least cost; of equally cheap edits the ASCII-least ones.
The search goes depth first in ASCII order of the edits under a cost bound,
which rises to the least cost that failed. A state is (turns consumed, place in
the pattern); the transposition table holds, for every state that failed, the
least remaining cost it may still need, so a state is left at once when that
exceeds what the bound leaves. The first accepting path is the answer.

Long conversations are cut into pieces of ``PIECE`` turns by a range sort, so
no task holds a conversation. A piece is searched once for every place in the
pattern it may be left at; a backward pass over these small cost tables tells
what the rest of the conversation costs from each place; each piece is searched
again with these costs at its end, from every place it may be entered at; and a
forward pass picks the entries. Since every edit leads to one place only, the
pieces' ASCII-least edits join to the conversation's. A conversation that lies
in one piece is searched at once. Costs of passes per conversation: 16 numbers
per piece. Only the digest of a repaired conversation reads its texts in one
(streaming) task, as a hash of their sequence has to.

Faults of a row, the first that counts: blank (no character but space and
x09-x0D), duplicate (role and text seen earlier in the conversation), truncated
(the last such character is none of ``.!?``). A row with an empty role has no
initial: keeping it leaves the pattern where it is.

Defined results: NULL role and text count as one space; turns are read by turn,
NULL first, equal turns by role and text; equal rows lie next to each other,
each but the first a duplicate; NULL conv_id is a conversation of its own;
``gaps`` is NULL if it exceeds a long; very long texts stay whole; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators.common import materialize, settled

PIECE = 64
SPACE = " \t\n\x0b\x0c\r"
INF = 1 << 60

# Places in the pattern, and the costs of the edits (fixed values).
START, SYSTEM, USER, ASSISTANT = range(4)
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
KEEP_TO = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT},
           "e": {q: q for q in range(4)}, "x": {}}
GIVE_TO = (USER, USER, ASSISTANT, USER)          # where an inserted or re-roled turn leads
ROLE_AT = (None, None, "user", "assistant")
TAIL = (0, 2 * INSERT, INSERT, 0)                # cost of the inserts that end a conversation here
TAIL_EDITS = ("", "II", "I", "")
LEGAL = {"su", "ua", "au"}


# --- search of one piece ----------------------------------------------------

def least_costs(initials: str, faults: str, end_costs) -> list[int]:
    """The transposition table at the start: for (turns consumed, place) a cost
    that the rest cannot undercut, INF where no end can be reached."""
    n = len(initials)
    need = [INF] * (4 * n) + list(end_costs)
    ends = [q for q in range(4) if end_costs[q] < INF]
    rest, has_system = min(end_costs), False
    for i in range(n - 1, -1, -1):
        c, f = initials[i], faults[i]
        if f in "bd":
            rest += DELETE
        else:
            cut = TRUNCATED if f == "t" else 0
            rest += min(DELETE, cut + (REROLE if c == "x" else 0))
            has_system |= c == "s"
        for q in range(4):
            if any(e >= USER or e == q or (q == START and e == SYSTEM and has_system) for e in ends):
                need[4 * i + q] = rest
    return need


def search(initials: str, faults: str, entry: int, need: list[int]):
    """Cheapest, then ASCII-least edits from place ``entry`` to an end, as
    ``(cost, edits, place at the end)``, or None. ``need`` (:func:`least_costs`)
    is sharpened; it may serve further entries."""
    n = len(initials)
    path: list[str] = []
    end = [entry]

    def descend(i: int, q: int, left: int) -> bool:
        if i == n:
            end[0] = q
            return True                          # need holds the exact cost at the end
        c, f, best = initials[i], faults[i], INF
        moves = [("D", DELETE, i + 1, q), ("I", INSERT, i, GIVE_TO[q])]
        if f not in "bd":
            cut = TRUNCATED if f == "t" else 0
            if q in KEEP_TO[c]:
                moves.append(("K", cut, i + 1, KEEP_TO[c][q]))
            moves.append(("R", REROLE + cut, i + 1, GIVE_TO[q]))
        for edit, cost, j, to in moves:
            if cost + need[4 * j + to] <= left:
                path.append(edit)
                if descend(j, to, left - cost):
                    return True
                path.pop()
            best = min(best, cost + need[4 * j + to])
        need[4 * i + q] = best
        return False

    while True:
        bound = need[entry]
        if bound >= INF:
            return None
        if descend(0, entry, bound):
            return bound, "".join(path), end[0]


def exit_costs(initials: str, faults: str) -> list:
    """Cost from each place to each place at the end, row by row (16 numbers; None: no way)."""
    out = [None] * 16
    for at_end in range(4):
        need = least_costs(initials, faults, [0 if q == at_end else INF for q in range(4)])
        for entry in range(4):
            found = search(initials, faults, entry, need)
            if found:
                out[4 * entry + at_end] = found[0]
    return out


def repaired(roles, texts, edits: str, entry: int):
    """``(edit, role, text)`` per turn that the edits keep, re-role or insert."""
    q, i = entry, 0
    for e in edits:
        if e == "D":
            i += 1
            continue
        if e == "K":
            role, text = roles[i], texts[i]
            first = role[:1]
            q = q if first == "" else KEEP_TO[first][q]
        else:
            q = GIVE_TO[q]
            role, text = ROLE_AT[q], "" if e == "I" else texts[i]
        i += e != "I"
        yield e, role, text


# --- rows, faults and pieces ------------------------------------------------

def damage(convs: DataFrame) -> DataFrame:
    """The stated damage of ``convs(conv_id, turn, role, text)``: by
    ``crc32("conv_id:turn") % 20`` a row is dropped (0), emptied (1), loses its
    ``.!?`` (2), is repeated (3, ``copies`` = 2) or said by the user (4)."""
    def spaced(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = convs.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"),
                        kind.alias("_kind")).where("_kind <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.when(F.col("_kind") == 3, 2).otherwise(1).alias("copies"))


def _marked(turns: DataFrame) -> DataFrame:
    """One row per distinct (conv_id, turn, role, text) with its copies, its
    role's initial (s, u, a; e: none, x: another) and its first copy's fault."""
    def spaced(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    copies = F.col("copies").cast("long") if "copies" in turns.columns else F.lit(1).cast("long")
    rows = turns.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"),
                        copies.alias("copies")) \
        .groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")) \
        .withColumn("_same", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))) \
        .withColumn("_place", F.struct(F.col("turn").isNotNull().alias("known"), "turn"))
    rows = materialize(rows, "repair-rows")
    first = rows.groupBy(F.col("conv_id").alias("_conv"), F.col("_same").alias("_said")) \
        .agg(F.min("_place").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    first = materialize(first, "repair-said")
    end = F.rtrim("text", F.lit(SPACE))
    fault = F.when(end == "", "b").when(~F.col("_first").eqNullSafe(F.col("_place")) & F.col("_first").isNotNull(), "d") \
        .when(~F.substring(end, -1, 1).isin(".", "!", "?"), "t").otherwise("-")
    initial = F.substring("role", 1, 1)
    return rows.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_same") == F.col("_said")), "left") \
        .select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"),
                F.when(initial == "", "e").when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"))


_PIECES = "conv_id long, piece long, whole boolean, initials string, faults string, " \
          "roles array<string>, texts array<string>"


def _cut(limit: int):
    def run(batches):
        held: list = []                          # (initial, fault, role, text) of the open piece
        conv, part, number, pieces_of_conv, convs = None, 0, 0, 0, 0

        def piece(whole: bool):
            nonlocal number, pieces_of_conv, held
            row = {"conv_id": conv, "piece": (part << 32) + number, "whole": whole,
                   "initials": "".join(h[0] for h in held), "faults": "".join(h[1] for h in held),
                   "roles": [h[2] for h in held], "texts": [h[3] for h in held]}
            number, pieces_of_conv, held = number + 1, pieces_of_conv + 1, []
            return row

        schema = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("whole", pa.bool_()),
                            ("initials", pa.string()), ("faults", pa.string()),
                            ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
        for batch in batches:
            out = []
            cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for conv_id, role, text, copies, fault, initial, here in zip(*cols):
                if not convs or conv_id != conv:
                    if held:
                        # the partition's first and last conversation may go on in the next ones
                        out.append(piece(convs > 1 and not pieces_of_conv))
                    conv, part, pieces_of_conv, convs = conv_id, here, 0, convs + 1
                for k in range(copies):
                    if len(held) == limit:
                        out.append(piece(False))
                    f = fault if k == 0 or fault == "b" else "d"
                    held.append((initial, f, role, "" if f in "bd" else text))
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if held:
            yield pa.RecordBatch.from_pylist([piece(False)], schema=schema)
    return run


def _pieces(turns: DataFrame, limit: int) -> DataFrame:
    rows = materialize(_marked(turns), "repair-marked")
    line = F.concat("role", F.lit("\0"), "text")
    # the range key is short, as samples of it go to the driver; equal prefixes stay in one partition
    ranged = rows.repartitionByRange("conv_id", F.asc_nulls_first("turn"), F.substring(line, 1, 64)) \
        .sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), line)
    cut = ranged.select(F.col("conv_id").cast("long"), "role", "text", "copies", "fault", "initial",
                        F.spark_partition_id().cast("long").alias("part")).mapInArrow(_cut(limit), _PIECES)
    return materialize(cut, "repair-pieces")


# --- passes over the pieces of long conversations ---------------------------

def _map_rows(fn, schema: pa.Schema):
    """mapInArrow function: ``fn`` turns an iterator over row dicts into one over row dicts."""
    def run(batches):
        rows = (r for b in batches for r in b.to_pylist())
        out = []
        for r in fn(rows):
            out.append(r)
            if len(out) >= 512:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    return run


def _by_conversation(rows):
    return groupby(rows, key=lambda r: r["conv_id"])


def _sorted(df: DataFrame, *order) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def _piece_costs(rows):
    for r in rows:
        yield {"conv_id": r["conv_id"], "piece": r["piece"], "costs": exit_costs(r["initials"], r["faults"])}


def _end_costs(rows):
    """Backward: what the rest of the conversation costs after each piece."""
    for _, pieces in _by_conversation(rows):
        rest = list(TAIL)
        for r in pieces:
            yield {"piece": r["piece"], "end_costs": rest}
            c = r["costs"]
            rest = [min(c[4 * q + e] + rest[e] for e in range(4) if c[4 * q + e] is not None) for q in range(4)]


def _piece_edits(rows):
    """The piece's edits from each place it may be entered at."""
    for r in rows:
        need = least_costs(r["initials"], r["faults"], r["end_costs"])
        found = [search(r["initials"], r["faults"], q, need) for q in range(4)]
        yield {"conv_id": r["conv_id"], "piece": r["piece"], "costs": [f[0] for f in found],
               "edits": [f[1] for f in found], "exits": [f[2] for f in found],
               "ends": r["initials"][0] + r["initials"][-1]}


def _picked(rows):
    """Forward: the entry of each piece, its edits, the conversation's cost at
    its first piece, and whether it meets the piece before legally."""
    for _, pieces in _by_conversation(rows):
        entry, before, waiting = START, "", None
        for r in pieces:
            if waiting:
                yield waiting
            waiting = {"piece": r["piece"], "entry": entry, "cost": 0 if before else r["costs"][entry],
                       "edits": r["edits"][entry], "joint": int(bool(before) and before + r["ends"][0] not in LEGAL)}
            entry, before = r["exits"][entry], r["ends"][1]
        waiting["edits"] += TAIL_EDITS[entry]
        yield waiting


def _whole_edits(rows):
    for r in rows:
        cost, edits, end = search(r["initials"], r["faults"], START, least_costs(r["initials"], r["faults"], TAIL))
        yield {**{c: r[c] for c in ("conv_id", "piece", "initials", "faults", "roles", "texts")},
               "entry": START, "cost": cost, "edits": edits + TAIL_EDITS[end], "joint": 0}


_EDITS = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("initials", pa.string()), ("faults", pa.string()),
                    ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("entry", pa.int32()),
                    ("cost", pa.int64()), ("edits", pa.string()), ("joint", pa.int32())])
_EDITS_SQL = "conv_id long, piece long, initials string, faults string, roles array<string>, texts array<string>, " \
             "entry int, cost long, edits string, joint int"


def _long_edits(pieces: DataFrame) -> DataFrame:
    longs = pa.list_(pa.int64())
    costs = materialize(pieces.select("conv_id", "piece", "initials", "faults").mapInArrow(
        _map_rows(_piece_costs, pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("costs", longs)])),
        "conv_id long, piece long, costs array<long>"), "repair-costs")
    ends = materialize(_sorted(costs, F.desc("piece")).mapInArrow(
        _map_rows(_end_costs, pa.schema([("piece", pa.int64()), ("end_costs", longs)])),
        "piece long, end_costs array<long>"), "repair-ends")
    edits = materialize(pieces.select("conv_id", "piece", "initials", "faults").join(ends, "piece").mapInArrow(
        _map_rows(_piece_edits, pa.schema([
            ("conv_id", pa.int64()), ("piece", pa.int64()), ("costs", longs), ("edits", pa.list_(pa.string())),
            ("exits", longs), ("ends", pa.string())])),
        "conv_id long, piece long, costs array<long>, edits array<string>, exits array<long>, ends string"),
        "repair-edits")
    picked = materialize(_sorted(edits, "piece").mapInArrow(
        _map_rows(_picked, pa.schema([("piece", pa.int64()), ("entry", pa.int32()), ("cost", pa.int64()),
                                      ("edits", pa.string()), ("joint", pa.int32())])),
        "piece long, entry int, cost long, edits string, joint int"), "repair-picked")
    return pieces.drop("whole").join(picked, "piece").select(*_EDITS.names)


def edited_pieces(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """``turns(conv_id, turn, role, text)``, each repeated ``copies`` times if
    that column is there -> one row per piece of a conversation, in order of
    ``piece``: its turns' initials and faults (b, d, t or -), roles and texts
    (empty where deleted at once), and its ``edits``; ``cost`` is the
    conversation's, at its first piece. ``whole``: the conversation is one piece."""
    def build() -> DataFrame:
        pieces = _pieces(turns, piece)
        whole = pieces.where("whole").drop("whole").mapInArrow(_map_rows(_whole_edits, _EDITS), _EDITS_SQL)
        return whole.withColumn("whole", F.lit(True)).unionByName(
            _long_edits(pieces.where("not whole")).withColumn("whole", F.lit(False)))
    return settled(turns.sparkSession, "repair", build)


def repaired_turns(edited: DataFrame) -> DataFrame:
    """The repaired conversations: ``(conv_id, piece, place, edit, role, text)``, in
    order of piece and place."""
    def run(rows):
        for r in rows:
            for i, (e, role, text) in enumerate(repaired(r["roles"], r["texts"], r["edits"], r["entry"])):
                yield {"conv_id": r["conv_id"], "piece": r["piece"], "place": i, "edit": e, "role": role, "text": text}
    schema = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("place", pa.int32()),
                        ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    return edited.mapInArrow(_map_rows(run, schema),
                             "conv_id long, piece long, place int, edit string, role string, text string")


def _summaries(rows):
    for conv_id, pieces in _by_conversation(rows):
        total = {"conv_id": conv_id, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0}
        audit, digest, begun = [], hashlib.sha256(), False
        for r in pieces:
            for name, letter in (("blank", "b"), ("duplicate", "d"), ("truncated", "t")):
                total[name] += r["faults"].count(letter)
            s = r["initials"]
            total["illegal"] += r["joint"] + sum(s[i:i + 2] not in LEGAL for i in range(len(s) - 1))
            total["cost"] += r["cost"]
            audit.append(r["edits"])
            for _, role, text in repaired(r["roles"], r["texts"], r["edits"], r["entry"]):
                digest.update(("\n" * begun + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                begun = True
        yield {**total, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}


_COUNTS = ["blank", "duplicate", "truncated", "illegal", "cost"]


def repair_report(convs: DataFrame, turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row per conversation of ``convs``, its turns being those of ``turns``:
    gaps, faults, cost, audit (the edits) and the digest of the repaired turns."""
    schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in _COUNTS),
                        ("audit", pa.string()), ("repaired_sha256", pa.string())])
    sql = "conv_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"

    def build() -> DataFrame:
        edited = edited_pieces(turns, piece)
        whole = edited.where("whole").mapInArrow(_map_rows(_summaries, schema), sql)
        cut = _sorted(edited.where("not whole"), "piece").mapInArrow(_map_rows(_summaries, schema), sql)
        found = materialize(whole.unionByName(cut).withColumnRenamed("conv_id", "_conv"), "repair-summaries")
        wide = "decimal(38,0)"
        gaps = turns.groupBy(F.col("conv_id").cast("long").alias("_gap")).agg(
            (F.max("turn").cast(wide) - F.min("turn").cast(wide) + 1 - F.countDistinct("turn"))
            .try_cast("long").alias("gaps"), F.count("turn").alias("_turns"))
        gaps = materialize(gaps.select("_gap", F.when(F.col("_turns") == 0, 0).otherwise(F.col("gaps")).alias("gaps"),
                                       F.lit(True).alias("_any")), "repair-gaps")
        return convs.select(F.col("conv_id").cast("long")).distinct() \
            .join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left") \
            .join(gaps, F.col("conv_id").eqNullSafe(F.col("_gap")), "left") \
            .select("conv_id", F.when(F.col("_any"), F.col("gaps")).otherwise(0).cast("long").alias("gaps"),
                    *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _COUNTS),
                    F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
    return settled(convs.sparkSession, "repair-report", build)
