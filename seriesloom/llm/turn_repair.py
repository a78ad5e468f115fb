"""Repair of conversation structure: every distinct sequence of roles and faults is solved once.

A conversation's rows, in order of turn, become a string of one letter for each
row (its role and first fault). Rows are sorted by ranges of conversation and
turn, so one conversation of any length is spread over tasks; each task writes
the letters of its stretch, and only those strings are put together.

Edits depend on nothing but the letters, and blank and repeated rows differ in
nothing when edits are sought, so conversations share few signatures. Each
distinct one is solved once: a stretch of letters is a table of the cheapest
edits from each state of the role pattern to each other, the table of a stretch
is that of its halves put together, and the tables of short stretches are
remembered. The recursion is as deep as the logarithm of the length.

Audits are joined back, and a task that reads a conversation's rows in order
replays its audit on them as a stream. That pass alone moves texts, once. The
hash of a repaired conversation is a chain over its text, so the rows of one
conversation go through one task there, one row at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Costs of edits, and of a truncated row that is not deleted.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: White space of a text, as in the pattern of a blank one.
SPACES = r"\x20\x09-\x0D"

#: Letters of rows by fault and role: system, user, assistant, another.
FINE, CUT, BLANK, AGAIN = "suao", "SUAO", "bcde", "wxyz"
#: In a signature all rows that have to go are one letter.
GONE = "-"
#: The role letters of all rows, for pairs of neighbours.
_ROLES = ("".join((FINE, CUT, BLANK, AGAIN)), FINE * 4)
#: States of the pattern (s?(ua)+)?: at its start, after s, after u, after a. The first and the last may end it.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = {"u": {_START: _USER, _SYSTEM: _USER, _ASSISTANT: _USER}, "a": {_USER: _ASSISTANT}, "s": {_START: _SYSTEM}}

Best = tuple[int, str]
Table = dict[tuple[int, int], Best]


def _relax(table: Table, at: tuple[int, int], new: Best) -> None:
    if at not in table or new < table[at]:
        table[at] = new


def _joined(a: Table, b: Table) -> Table:
    """Of two edits of equal costs neither begins with the other (one more insertion would cost more), so the least audit of
    a stretch is made of the least ones of its parts."""
    out: Table = {}
    for (i, j), (cost, audit) in a.items():
        for k in range(4):
            if (j, k) in b:
                more, rest = b[j, k]
                _relax(out, (i, k), (cost + more, audit + rest))
    return out


def _inserted() -> Table:
    """Any number of insertions, none included; more than three would come back to a state."""
    once: Table = {(i, i): (0, "") for i in range(4)}
    for moves in (_NEXT["u"], _NEXT["a"]):
        for i, j in moves.items():
            _relax(once, (i, j), (INSERT, "I"))
    out = once
    for _ in range(2):
        out = _joined(out, once)
    return out


_INSERTED = _inserted()


@lru_cache(maxsize=None)
def _row(letter: str) -> Table:
    """Insertions before a row, and its own edit."""
    own: Table = {(i, i): (DELETE, "D") for i in range(4)}
    if letter != GONE:
        extra = TRUNCATED if letter in CUT else 0
        for i, j in _NEXT.get(letter.lower(), {}).items():
            _relax(own, (i, j), (KEEP + extra, "K"))
        for role in "ua":
            for i, j in _NEXT[role].items():
                _relax(own, (i, j), (REROLE + extra, "R"))
    return _joined(_INSERTED, own)


def _stretch(letters: str) -> Table:
    if len(letters) == 1:
        return _row(letters)
    half = 1 << (len(letters) - 1).bit_length() - 1
    solve = _short if half <= 32 else _stretch
    return _joined(solve(letters[:half]), solve(letters[half:]))


@lru_cache(maxsize=50_000)
def _short(letters: str) -> Table:
    return _stretch(letters)


def solve_signature(letters: str) -> Best:
    """(cost, audit) of the cheapest edits that make the roles fit the pattern, of equally cheap ones the least audit."""
    table = _joined(_stretch(letters), _INSERTED) if letters else _INSERTED
    return min(table[_START, end] for end in (_START, _ASSISTANT) if (_START, end) in table)


def _or_space(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): the rows with a damage that the checksum of id and turn chooses, n times each (0: dropped)."""
    way = F.crc32(F.concat(_or_space("conv_id"), F.lit(":"), _or_space("turn")).cast("binary")) % 20
    text, role = _or_space("text"), _or_space("role")
    return conversations.select(
        "conv_id", "turn", F.when(way == 4, "user").otherwise(role).alias("role"),
        F.when(way == 1, "").when(way == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), F.when(way == 0, 0).when(way == 3, 2).otherwise(1).alias("n"),
    )


_ORDER = ("turn", "role", "digest")


def _faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, n, letter, first): rows that are equal are one, n times. first: no equal role and text came before."""
    text = F.col("text")
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(4)
    last = F.regexp_extract(text, f"([^{SPACES}])[{SPACES}]*\\z", 1)
    fault = F.when(~text.rlike(f"[^{SPACES}]"), BLANK).when(~last.isin(*".!?"), CUT).otherwise(FINE)
    rows = rows.select("conv_id", "turn", "role", F.unhex(F.sha2(text, 256)).alias("digest"), F.substring(fault, place, F.lit(1)).alias("letter"), F.substring(F.lit(AGAIN), place, F.lit(1)).alias("again"), "n")
    rows = rows.groupBy("conv_id", *_ORDER, "letter", "again").agg(F.sum("n").alias("n"))
    there = F.when(F.col("n") > 0, F.struct(F.col("turn").isNotNull(), "turn"))
    firsts = rows.groupBy("conv_id", "role", "digest").agg(F.min(there).alias("earliest"))
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("conv_id", "role", "digest")]
    found = rows.alias("r").join(firsts.alias("f"), on)
    return found.select("r.*", F.col("earliest").eqNullSafe(F.struct(F.col("r.turn").isNotNull(), "r.turn")).alias("first"))


_STRETCH = "turn {turn}, role string, digest binary, low {turn}, high {turn}, last {turn}, turns bigint, letters string"


def _stretches(faults: DataFrame) -> DataFrame:
    """A row for each conversation and task: where the stretch begins, its smallest, largest and last turn, the number of
    turns, and the letters of its rows."""
    kinds = {c: faults.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    rows = faults.select("conv_id", *_ORDER, "letter", "again", "n", "first")
    rows = rows.repartitionByRange("conv_id", *_ORDER).sortWithinPartitions("conv_id", *_ORDER)
    names = ["conv_id", *_ORDER, "low", "high", "last", "turns", "letters"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now, schema = [], None, None
        for b in batches:
            if schema is None:
                turn = b.schema.field("turn").type
                schema = pa.schema([("conv_id", b.schema.field("conv_id").type), ("turn", turn), ("role", pa.string()), ("digest", pa.binary()), ("low", turn), ("high", turn), ("last", turn), ("turns", pa.int64()), ("letters", pa.string())])
            for conv, turn, role, digest, letter, again, n, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or now["conv_id"] != conv:
                    if now is not None:
                        done.append(now)
                    now = {"conv_id": conv, "turn": turn, "role": role, "digest": digest, "low": None, "high": None, "last": None, "turns": 0, "letters": []}
                if n:
                    if turn is not None:
                        now["low"] = turn if now["low"] is None else now["low"]
                        now["turns"] += turn != now["last"]
                        now["high"] = now["last"] = turn
                    head = letter if first or letter in BLANK else again
                    now["letters"].append(head + (letter if letter in BLANK else again) * (n - 1))
                if len(done) >= 10_000:
                    yield _table(done, schema)
                    done = []
        if now is not None:
            yield _table([*done, now], schema)

    def _table(done: list[dict], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([d | {"letters": "".join(d["letters"])} for d in done], schema).select(names)

    return rows.mapInArrow(run, f"conv_id {kinds['conv_id']}, " + _STRETCH.format(turn=kinds["turn"]))


def signatures(conversations: DataFrame) -> DataFrame:
    """(conv_id, letters, gaps, blank, duplicate, truncated, illegal, signature) of every conversation (conv_id, turn, role, text, n)."""
    parts = _stretches(_faults(conversations))
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in parts.columns if c != "conv_id"]))).alias("parts"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("turns").alias("turns"))
    # a turn whose rows two tasks hold was counted by both: a stretch with an earlier known turn counts one that it shares once
    seen = F.filter("parts", lambda p: p["last"].isNotNull())
    shared = F.aggregate(F.sequence(F.lit(2), F.greatest(F.size(seen), F.lit(2))), F.lit(0).cast("bigint"), lambda n, k: n + F.when(F.try_element_at(seen, k)["low"] == F.try_element_at(seen, k - 1)["last"], 1).otherwise(0))
    letters = F.array_join(F.transform("parts", lambda p: p["letters"]), "")
    out = whole.select("conv_id", letters.alias("letters"), F.coalesce(F.col("high") - F.col("low") + 1 - (F.col("turns") - shared), F.lit(0)).cast("bigint").alias("gaps"))
    roles = F.translate("letters", *_ROLES)
    count = lambda kinds: (F.length("letters") - F.length(F.translate("letters", kinds, ""))).cast("bigint")
    pairs = F.greatest(F.length("letters") - 1, F.lit(0)) - F.regexp_count(roles, F.lit("(?=su|ua|au)"))
    return out.select(
        "conv_id", "letters", "gaps", count(BLANK).alias("blank"), count(AGAIN).alias("duplicate"), count(CUT).alias("truncated"), pairs.cast("bigint").alias("illegal"),
        F.translate("letters", BLANK + AGAIN, GONE * 8).alias("signature"),
    )


def solved(found: DataFrame) -> DataFrame:
    """(signature, cost, audit) of each distinct signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            letters = b.column(0).to_pylist()
            best = [solve_signature(s) for s in letters]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c for c, _ in best], pa.int64()), pa.array([a for _, a in best], pa.string())], ["signature", "cost", "audit"])

    return found.select("signature").distinct().mapInArrow(run, "signature string, cost bigint, audit string")


def _replayed(rows: DataFrame, audits: DataFrame, texts: bool) -> DataFrame:
    """Edits applied to rows in order. texts: the repaired rows (conv_id, position, role, text, edit), else all columns of
    the audits (conv_id, audit and others) with the digest of the repaired conversation, repaired_sha256."""
    given = [c for c in audits.columns if c != "conv_id"]
    pack = F.struct(*given)
    kind = audits.select(pack.alias("p")).schema["p"].dataType
    head = audits.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), F.lit("").alias("text"), F.lit(1).alias("n"), pack.alias("given"))
    body = rows.where("n > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "text", "n", F.lit(None).cast(kind).alias("given"))
    both = head.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_ORDER).drop("digest", "turn")
    conv_id = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}"

    def edits(batches: Iterator[pa.RecordBatch]):
        """(conv_id, given, None) when a conversation begins, then (conv_id, None, (role, text, edit)) for each of its rows after repair."""
        conv, audit, at, last = None, "", 0, ""

        def inserted():
            nonlocal at, last
            while at < len(audit) and audit[at] == "I":
                role = "assistant" if last == "u" else "user"
                last, at = role[0], at + 1
                yield conv, None, (role, "", "I")

        for b in batches:
            for one, is_row, role, text, n, head in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not is_row:
                    yield from inserted()
                    conv, audit, at, last = one, head["audit"], 0, ""
                    yield conv, head, None
                    continue
                for _ in range(n):
                    yield from inserted()
                    edit, at = audit[at], at + 1
                    if edit != "D":
                        now = role if edit == "K" else "assistant" if last == "u" else "user"
                        last = now[0]
                        yield conv, None, (now, text, edit)
        yield from inserted()

    def digests(found):
        """(conv_id, the audit's columns, digest)."""
        now, digest, begun = None, None, False
        for conv, head, row in found:
            if row is None:
                if now:
                    yield (*now, digest.hexdigest())
                now, digest, begun = (conv, *head.values()), hashlib.sha256(), False
            else:
                digest.update(("\n" if begun else "").encode() + f"{row[0]}:{row[1]}".encode())
                begun = True
        if now:
            yield (*now, digest.hexdigest())

    def numbered(found):
        position = 0
        for conv, _, row in found:
            if row is not None:
                yield (conv, position, *row)
            position = 0 if row is None else position + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def noted(batches):
            for b in batches:
                if not kinds:
                    packed = b.schema.field("given").type
                    kinds.append(b.schema.field("conv_id").type)
                    kinds.extend([pa.int64(), pa.string(), pa.string(), pa.string()] if texts else [*[packed.field(k).type for k in range(packed.num_fields)], pa.string()])
                yield b

        def table(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

        done, size = [], 0
        for row in (numbered if texts else digests)(edits(noted(batches))):
            done.append(row)
            size += len(row[3]) if texts else len(row[names.index("audit")])
            if len(done) >= 2_000 or size > 1 << 22:
                yield table(done)
                done, size = [], 0
        if done:
            yield table(done)

    names = ["conv_id", "position", "role", "text", "edit"] if texts else ["conv_id", *given, "repaired_sha256"]
    rest = "position bigint, role string, text string, edit string" if texts else ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in kind.fields], "repaired_sha256 string"])
    return both.mapInArrow(run, f"{conv_id}, {rest}")


def audited(rows: DataFrame) -> DataFrame:
    """signatures() of rows with the cost and audit of each; a signature that many conversations share is split by adaptive
    execution."""
    found = signatures(rows)
    return found.join(solved(found), "signature").drop("signature")


def as_rows(conversations: DataFrame) -> DataFrame:
    """Conversations as the operators here take them: (conv_id, turn, role, text, n), each row once; a missing text or role is a space."""
    return conversations.select("conv_id", "turn", _or_space("role").alias("role"), _or_space("text").alias("text"), F.lit(1).alias("n"))


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, position, role, text, edit): conversations (conv_id, turn, role, text, n) as repaired, with the edit that each row comes from."""
    return _replayed(rows, audited(rows), True)


def repair_report(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row for each conversation.

    Missing texts and roles are a space, missing ids a conversation of their own; rows of one turn are taken by role, then
    by SHA-256 of the text, rows without turn before all others. A conversation of which no row is left has zeros, no
    edits and the digest of nothing. Other columns are not looked at; an empty table gives an empty one.
    """
    return _replayed(rows, audited(rows).drop("letters"), False)
