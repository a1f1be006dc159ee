"""Chat formatting: a hidden Markov model recovers who speaks in a transcript.

Of a raw transcript, a state is a role and whether a line begins a turn or continues one. A
line shows its speaker marker (if any), whether a blank line comes before it, whether it
ends as a question, its length, and whether it is the transcript's first. Of a table of
turns it is known where turns begin, so a state is a role, and a turn shows all its lines.

Transitions and line features are counted over all labelled turns; how often markers are
missing or wrong is a stated prior. Viterbi finds the best states, and turns are written
in canonical form. Roles that a table states are kept, also those that the model doesn't know.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import quoted, small_batches, stored

ROLES = ("system", "user", "assistant")
#: The number of any other role. It is never recovered, only stated.
OTHER = 3
BEGIN, INSIDE = 0, 1
#: Rows and characters of a piece of a conversation. Pieces are read in parallel; where they are cut changes nothing.
PIECE_ROWS, PIECE_CHARS = 4_096, 4 << 20
#: Log probabilities are whole numbers, this many to 1: sums are exact, however they are grouped.
_UNIT = 1 << 26
#: The impossible; twice this and a step still fit 64 bits.
_NEVER = -(1 << 60)
#: Names that speakers go by, per role.
NAMES = {
    "system": ("system", "sys", "instructions", "context"),
    "user": ("user", "human", "customer", "me", "you", "question", "q", "prompter", "student"),
    "assistant": ("assistant", "ai", "bot", "gpt", "chatbot", "model", "agent", "answer", "a", "tutor"),
}
_ROLE_OF = {n: r for r, names in NAMES.items() for n in names}
_MARK = re.compile(
    r"^\s*(?:(?:\*\*|__|#{1,4}\s*|>\s*)?([A-Za-z]+)(?:\*\*|__)?\s*:(?:\*\*|__)?|<\|?([A-Za-z]+)\|?>:?|\[([A-Za-z]+)\]:?)[ \t]?"
)
#: Kinds of marker: none, those of the three roles.
NO_MARK = 3
#: Prior: of lines that begin a turn, these shares have no marker, or that of another role.
MISSING, WRONG = 0.08, 0.002
#: Prior: of lines inside a turn, this share looks like a marker of each role.
CHANCE = 0.004
_LENGTHS = (20, 60, 140, 400)


def marker(line: str) -> tuple[int, str]:
    """The kind of the line's speaker marker, and the line without it."""
    if m := _MARK.match(line):
        role = _ROLE_OF.get((m[1] or m[2] or m[3]).lower())
        if role:
            return ROLES.index(role), line[m.end() :]
    return NO_MARK, line


def shape(line: str) -> int:
    """Length and question mark of a line as one of ten numbers."""
    k = sum(len(line) > n for n in _LENGTHS)
    return 2 * k + line.rstrip().endswith("?")


def _log(x: np.ndarray) -> np.ndarray:
    return np.rint(np.log(np.maximum(x, 1e-12)) * _UNIT).astype(np.int64)


class Model:
    """Log probabilities. starts: of the first turn's role; turns: of the role after a role; shapes:
    per role of first and other lines; ends: that a turn ends after a line. All with OTHER last."""

    def __init__(self, starts: np.ndarray, turns: np.ndarray, shapes: np.ndarray, ends: np.ndarray):
        n = len(ROLES)
        # lines of a raw transcript: states 2 * role + (BEGIN or INSIDE)
        self.start = np.full(2 * n, _NEVER, np.int64)
        self.start[0::2] = _log(starts[:n])
        self.step = np.full((2 * n, 2 * n), _NEVER, np.int64)
        for r in range(n):
            for b in (BEGIN, INSIDE):
                self.step[2 * r + b, 2 * r + INSIDE] = _log(1 - ends[r])
                self.step[2 * r + b, 0::2] = _log(ends[r]) + _log(turns[r, :n])
        self.shape = _log(np.concatenate([shapes[r, b][None] for r in range(n) for b in (BEGIN, INSIDE)]))
        mark = np.full((2 * n, n + 1), CHANCE)
        for r in range(n):
            mark[2 * r + BEGIN] = WRONG
            mark[2 * r + BEGIN, r] = 1 - MISSING - WRONG * (n - 1)
            mark[2 * r + BEGIN, NO_MARK] = MISSING
            mark[2 * r + INSIDE, NO_MARK] = 1 - CHANCE * n
        self.mark = _log(mark)
        # after a blank line a turn begins more often, and continues less often
        self.blank = _log(np.tile(np.array([[0.6, 0.4], [0.85, 0.15]]), (n, 1)))
        # turns of a table: states are roles, OTHER among them
        self.turn_start, self.turn_step = _log(starts), _log(ends)[:, None] + _log(turns)
        #: by marker and shape of a turn's first line, and by shape of a line inside
        self.first = np.full((n + 1, 10, n + 1), _NEVER, np.int64)
        self.first[:, :, :n] = self.mark[BEGIN::2].T[:, None, :] + _log(shapes[:n, BEGIN]).T[None]
        self.inner = np.zeros((10, n + 1), np.int64)
        self.inner[:, :n] = (_log(shapes[:n, INSIDE]) + _log(1 - ends[:n])[:, None]).T

    def emission(self, line: str, blank: bool) -> np.ndarray:
        kind, rest = marker(line)
        return self.mark[:, kind] + self.shape[:, shape(rest)] + self.blank[:, int(blank)]

    def states(self, lines: list[tuple[str, bool]]) -> list[int]:
        """The most probable states of (line, blank before) pairs; of equal ones the first."""
        return best_paths([np.array([self.emission(*x) for x in lines], np.int64).reshape(-1, len(self.start))], self.start, self.step)[0].tolist()

    def seen(self, rows: list[tuple[int | None, str]]) -> np.ndarray:
        """For rows of (role, text) the turns' log probabilities by role: (2, rows, roles). First what
        is known, where a stated role rules out all others, then without any stated role."""
        first = np.zeros((len(rows), 2), np.int64)
        inside = np.zeros((len(rows), 10), np.int64)
        empty = np.zeros(len(rows), bool)
        for i, (_, text) in enumerate(rows):
            lines = _lines(text)
            if not lines:
                empty[i] = True
                continue
            kind, rest = marker(lines[0])
            first[i] = kind, shape(rest)
            for x in lines[1:]:
                inside[i, shape(x)] += 1
        unseen = self.first[first[:, 0], first[:, 1]] + inside @ self.inner
        unseen[empty, :OTHER] = 0
        unseen[:, OTHER] = _NEVER
        told = np.array([-1 if r is None else r for r, _ in rows], np.int64)
        known = unseen.copy()
        some = np.flatnonzero(told >= 0)
        known[some] = _NEVER
        known[some, told[some]] = 0
        return np.stack([known, unseen])


def best_paths(found: list[np.ndarray], start: np.ndarray, step: np.ndarray) -> list[np.ndarray]:
    """Viterbi over many sequences of emissions (length, states) at a time; of equal paths the first."""
    order = sorted(range(len(found)), key=lambda i: -len(found[i]))
    sizes = np.array([len(found[i]) for i in order], np.int64)
    longest = int(sizes[0]) if len(sizes) else 0
    left = np.searchsorted(-sizes, -np.arange(longest), "left")  # sequences longer than t, for each t
    n = len(start)
    back = [np.zeros((0, n), np.uint8)] * longest
    best = np.full((len(order), n), _NEVER, np.int64)
    for t in range(longest):
        m = int(left[t])
        here = np.array([found[i][t] for i in order[:m]], np.int64)
        if t:
            ways = best[:m, :, None] + step
            back[t] = ways.argmax(axis=1).astype(np.uint8)
            here = here + ways.max(axis=1)
        else:
            here = here + start
        best[:m] = np.maximum(here, _NEVER)
    out = [np.zeros(len(found[i]), np.uint8) for i in order]
    at = best.argmax(axis=1).astype(np.uint8)
    for t in range(longest - 1, -1, -1):
        m = int(left[t])
        for k in range(m):
            out[k][t] = at[k]
        if t:
            at[:m] = back[t][np.arange(m), at[:m]]
    done: list = [None] * len(found)
    for i, x in zip(order, out):
        done[i] = x
    return done


def paths(e: np.ndarray, before: np.ndarray | None, start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each state of the last of some emissions: the best score, the state before all of them that
    leads there, and the states on the way. before: scores by state of what came before, if any."""
    n, back, best = len(start), [], before
    for x in e:
        if best is None:
            back.append(np.zeros(n, np.uint8))
            best = start
        else:
            ways = best[:, None] + step
            back.append(ways.argmax(axis=0).astype(np.uint8))
            best = ways.max(axis=0)
        best = np.maximum(best + x, _NEVER)
    at, out = np.arange(n, dtype=np.uint8), np.empty((n, len(e)), np.uint8)
    for k in range(len(e) - 1, -1, -1):
        out[:, k] = at
        at = back[k][at]
    return best, at, out


def product(e: np.ndarray, step: np.ndarray) -> np.ndarray:
    """From each state before some emissions to each state of the last, the best score."""
    best = np.where(np.eye(len(step), dtype=bool), 0, _NEVER)
    for x in e:
        best = np.maximum((best[:, :, None] + step).max(axis=1) + x, _NEVER)
    return best


def _in_order(rows: DataFrame, *by: str) -> DataFrame:
    """rows sorted by conv and by, dealt by ranges of that order: a long conversation is many tasks'."""
    # ranges go by the beginnings of texts, as their limits are held by the driver
    ends = [F.substring(c, 1, 64) if dict(rows.dtypes)[c] == "string" else F.col(c) for c in ("conv", *by)]
    return rows.repartitionByRange(*ends).sortWithinPartitions("conv", *by)


def fit(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Model:
    """Counts over all rows with a stated role, plus one each. Only the counts reach the driver.

    Null and blank roles aren't stated; those that no name of NAMES stands for are all one. An empty
    table gives a model for which everything is equally likely.
    """
    name = F.lower(F.trim(quoted(role_col).cast("string")))
    known = F.create_map(*[F.lit(x) for n, r in _ROLE_OF.items() for x in (n, ROLES.index(r))])
    role = F.when(F.coalesce(name, F.lit("")) != "", F.coalesce(F.try_element_at(known, name), F.lit(OTHER)))
    t = turns.select(
        quoted(conv_col).alias("conv"), F.coalesce(quoted(turn_col).cast("long"), F.lit(0)).alias("turn"), role.alias("role"),
        F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"),
    )
    n = OTHER + 1
    starts, steps = np.ones(n), np.ones((n, n))
    for before, role, count in _role_pairs(t):
        if before is None:
            starts[role] += count
        else:
            steps[before, role] += count
    lines = t.where("role IS NOT NULL").select("role", F.posexplode(F.split("text", "\n")).alias("at", "line")).where("trim(line) <> ''")
    size = sum((F.when(F.length("line") > k, 1).otherwise(0) for k in _LENGTHS), F.lit(0))
    form = size * 2 + F.when(F.rtrim("line").endswith("?"), 1).otherwise(0)
    shapes, turns_of, lines_of = np.ones((n, 2, 10)), np.ones(n), np.full(n, 2.0)
    for r in lines.groupBy("role", (F.col("at") > 0).cast("int").alias("inside"), form.alias("form")).count().collect():
        shapes[r["role"], r["inside"], r["form"]] += r["count"]
        lines_of[r["role"]] += r["count"]
        turns_of[r["role"]] += r["count"] * (1 - r["inside"])
    return Model(starts / starts.sum(), steps / steps.sum(axis=1, keepdims=True), shapes / shapes.sum(axis=2, keepdims=True), np.minimum(turns_of / lines_of, 0.999))


def _role_pairs(t: DataFrame) -> list[tuple[int | None, int, int]]:
    """(role of the row before, role, how often) over all conversations; none before: first, or not known.

    A task counts its range of rows and leaves its first row to the driver, which gets the rows
    at the ends of each task's range besides the counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int | None, int], int] = {}
        first = last = None
        for b in batches:
            for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if last is None:
                    first = row
                elif row[1] is not None:
                    pair = (last[1] if last[0] == row[0] else None, row[1])
                    counts[pair] = counts.get(pair, 0) + 1
                last = row
        if first is None:
            return
        at = TaskContext.get().partitionId()
        out = [(at, "pair", None, *k, v) for k, v in counts.items()] + [(at, "end", c, None, r, i) for i, (c, r) in enumerate((first, last))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, y) for x, y in zip(zip(*out), (pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))], ["task", "kind", "conv", "before", "role", "n"]
        )

    # the text isn't needed: among rows equal in all else it doesn't change which roles follow each other
    rows = _in_order(t.select(F.col("conv").cast("long").alias("conv"), "turn", "role"), "turn", "role").select("conv", "role")
    found = rows.mapInArrow(run, "task int, kind string, conv long, before int, role int, n long").collect()
    out = [(r["before"], r["role"], r["n"]) for r in found if r["kind"] == "pair"]
    last = None
    for r in sorted((r for r in found if r["kind"] == "end"), key=lambda r: (r["task"], r["n"])):
        if r["n"] == 0 and r["role"] is not None:
            out.append((last["role"] if last and last["conv"] == r["conv"] else None, r["role"], 1))
        last = r
    return out


def _lines(text: str) -> list[str]:
    """The lines that aren't blank."""
    return [x for x in re.split(r"\r\n|\r|\n", text) if x.strip()]


def transcript_lines(text: str) -> list[tuple[str, bool]]:
    """(line, blank before) of the lines that aren't blank."""
    out, blank = [], False
    for line in re.split(r"\r\n|\r|\n", text):
        if line.strip():
            out.append((line, blank))
            blank = False
        else:
            blank = True
    return out


def parse(model: Model, text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a raw transcript."""
    lines = transcript_lines(text)
    turns: list[tuple[str, list[str]]] = []
    for (line, blank), state in zip(lines, model.states(lines)):
        role, inside = divmod(state, 2)
        if inside == BEGIN or not turns:
            kind, rest = marker(line)
            turns.append((ROLES[role], [(rest if kind == role else line).strip()]))
        else:
            turns[-1][1].extend(([""] if blank else []) + [line.rstrip()])
    return [(r, "\n".join(x).strip()) for r, x in turns]


def role_number(role: str | None) -> int | None:
    """The number of a stated role, None if it states none."""
    name = (role or "").strip().lower()
    return None if not name else ROLES.index(_ROLE_OF[name]) if name in _ROLE_OF else OTHER


def turn(role: str | None, text: str | None, state: int) -> tuple[str, str]:
    """(role, text) of a row. Its text is as it was, but that a recovered role's own marker goes."""
    stated, text = role_number(role), text or ""
    if stated is not None:
        return ROLES[stated] if stated != OTHER else role.strip(), text
    head = re.match(r"\s*", text).end()
    line = re.split(r"\r|\n", text[head:], maxsplit=1)[0]
    kind, rest = marker(line)
    return ROLES[state], text[head + len(line) - len(rest) :] if kind == state else text


def render(turns: list[tuple[str, str]]) -> str:
    """The canonical form of turns. A text can't end its own turn: its end marks are broken up, and
    what could end a role's line is left out of its name."""
    clean = lambda t: re.sub(r"<\|(im_start|im_end)\|>", r"<| \1 |>", t)
    return "".join(f"<|im_start|>{' '.join(clean(r).split())}\n{clean(t)}<|im_end|>\n" for r, t in turns)


def format_transcripts(transcripts: DataFrame, model: Model, id_col: str = "conv_id", text_col: str = "text") -> DataFrame:
    """conv_id, n_turns, n_lines, roles, rendered: one row per row, from raw transcripts.

    Null and blank transcripts have no turns and render as the empty text.
    """
    small_batches(transcripts.sparkSession)
    shared = transcripts.sparkSession.sparkContext.broadcast(vars(model))
    rows = transcripts.select(quoted(id_col).cast("long").alias("conv_id"), quoted(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(shared.value)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            found = [parse(m, t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([len(_lines(t)) for t in texts], pa.int64()),
                    pa.array([",".join(r for r, _ in x) for x in found], pa.string()), pa.array([render(x) for x in found], pa.string()),
                ],
                ["conv_id", "n_turns", "n_lines", "roles", "rendered"],
            )

    return rows.mapInArrow(run, "conv_id long, n_turns long, n_lines long, roles string, rendered string")


def _model(values: dict) -> Model:
    m = Model.__new__(Model)
    m.__dict__.update(values)
    return m


_OUT = "conv_id long, n_turns long, n_lines long, n_recovered long, n_agree long, roles string, unseen_roles string, rendered string"


def _named(roles: list[str]) -> str:
    return ",".join(r.replace(",", " ") for r in roles)


def _written(found: list[tuple[int | None, list[tuple[str | None, str | None]], np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Output rows of (conversation, its rows, states as known, states unseen)."""
    out: list[tuple] = []
    for conv, rows, known, unseen in found:
        turns = [turn(r, t, int(k)) for (r, t), k in zip(rows, known)]
        told = [role_number(r) for r, _ in rows]
        agree = sum(t is not None and t == u for t, u in zip(told, unseen.tolist()))
        lines = sum(len(_lines(t or "")) for _, t in rows)
        out.append((conv, len(rows), lines, sum(t is None for t in told), agree, _named([r for r, _ in turns]), ",".join(ROLES[u] for u in unseen.tolist()), render(turns)))
    return pa.RecordBatch.from_pylist([dict(zip(_OUTPUT.names, r)) for r in out], _OUTPUT)


def format_conversations(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", piece_rows: int = PIECE_ROWS, model: Model | None = None,
) -> DataFrame:
    """conv_id, n_turns, n_lines, n_recovered, n_agree, roles, unseen_roles, rendered: a row per conversation.

    A row is a turn. Rows are in the order of turn, then role, then text; a null turn counts as 0, a
    null text as empty, a null or blank role as not stated. A stated role is kept as it is (by its
    canonical name, if it has one); one that isn't is recovered: n_recovered counts those. Texts are
    rendered as they are, but for a recovered role's own marker. unseen_roles is what the model makes
    of the texts alone, and n_agree how many stated roles are the same there, which tells how far
    recovered ones can be trusted, or which conversations are labelled oddly. Null conv_ids are one
    conversation. An empty table gives an empty result. Without a model one is fitted on the table.

    Rows are dealt by ranges of their order. Conversations that may go on in another task, or are
    long, become pieces: each gives the best scores between its ends, those are chained to get
    the scores before each piece, and from there each piece finds its states, the same as if
    all turns had been read in one go. Only the row's own text is put together in one task.
    """
    spark = turns.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(vars(model or fit(turns, conv_col, turn_col, role_col, text_col)))
    t = turns.select(
        quoted(conv_col).cast("long").alias("conv"), F.coalesce(quoted(turn_col).cast("long"), F.lit(0)).alias("turn"),
        quoted(role_col).cast("string").alias("role"), quoted(text_col).cast("string").alias("text"),
    )
    n = OTHER + 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(conv, rows, whether they are the whole conversation) of pieces."""
        first = True
        last = None  # the last piece of a conversation is held back till the next one begins
        for conv, group in groupby(read(batches), key=lambda r: r[0]):
            if last:
                yield *last, not first
                first = False
            last, whole, held, size = None, True, [], 0
            for _, _, role, text in group:
                if held and (len(held) >= piece_rows or size >= PIECE_CHARS):
                    yield conv, held, False
                    whole, first, held, size = False, False, [], 0
                held.append((role, text))
                size += len(text or "")
            if whole:
                last = conv, held
            else:
                yield conv, held, False
        if last:
            yield *last, False

    def seen(m: Model, rows: list) -> np.ndarray:
        return m.seen([(role_number(r), t or "") for r, t in rows])

    def finished(m: Model, done: list) -> pa.RecordBatch:
        both = [seen(m, rows) for _, rows in done]
        ways = best_paths([e for pair in both for e in pair], m.turn_start, m.turn_step)
        return _filled(_written([(conv, rows, ways[2 * i], ways[2 * i + 1]) for i, (conv, rows) in enumerate(done)]), _PIECE)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, task, seq = _model(shared.value), TaskContext.get().partitionId(), 0
        done: list[tuple] = []
        size = 0
        for conv, rows, whole in cut(batches):
            if whole:
                done.append((conv, rows))
                size += sum(len(t or "") for _, t in rows)
                if len(done) == 256 or size >= PIECE_CHARS:
                    yield finished(m, done)
                    done, size = [], 0
                continue
            seq += 1
            e = seen(m, rows)
            opening = np.stack([paths(x, None, m.turn_start, m.turn_step)[0] for x in e])
            through = np.stack([product(x, m.turn_step) for x in e])
            row = (conv, task, seq, [r for r, _ in rows], [t for _, t in rows], e.tobytes(), opening.tobytes(), through.tobytes())
            yield pa.RecordBatch.from_pylist([dict(zip(("conv_id", *_PIECES), row))], _PIECE)
        if done:
            yield finished(m, done)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby(read(batches), key=lambda r: r[0]):
            before = None
            for _, task, seq, opening, through in group:
                yield pa.RecordBatch.from_pylist([{"of_task": task, "of_seq": seq, "before": None if before is None else before.tobytes()}], _BEFORE)
                if before is None:
                    before = np.frombuffer(opening, np.int64).reshape(2, n)
                else:
                    before = np.maximum((before[:, :, None] + np.frombuffer(through, np.int64).reshape(2, n, n)).max(axis=1), _NEVER)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(shared.value)
        for conv, task, seq, roles, texts, e, before in read(batches):
            e = np.frombuffer(e, np.int64).reshape(2, -1, n)
            start = [None, None] if before is None else np.frombuffer(before, np.int64).reshape(2, n)
            found = [paths(x, b, m.turn_start, m.turn_step) for x, b in zip(e, start)]
            row = (conv, task, seq, roles, texts, *(np.stack([f[k] for f in found]).tobytes() for k in range(3)))
            yield pa.RecordBatch.from_pylist([dict(zip(_WALKED.names, row))], _WALKED)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, group in groupby(read(batches), key=lambda r: r[0]):
            rows, ends = [], []
            for *_, roles, texts, last, back, ways in group:
                rows += zip(roles, texts)
                ends.append([np.frombuffer(x, k).reshape(2, n, *more) for x, k, more in ((last, np.int64, ()), (back, np.uint8, ()), (ways, np.uint8, (-1,)))])
            states = []
            for k in range(2):
                at, parts = int(ends[-1][0][k].argmax()), []
                for _, back, ways in reversed(ends):
                    parts.append(ways[k, at])
                    at = int(back[k, at])
                states.append(np.concatenate(parts[::-1]))
            yield _written([(conv, rows, *states)])

    cuts = stored(_in_order(t, "turn", "role", "text").mapInArrow(pieces, f"{_OUT}, {_PIECE_SQL}"), "chat-pieces")
    parts = cuts.where("task IS NOT NULL")
    ends = parts.select("conv_id", "task", "seq", "opening", "through")
    ends = ends.repartition("conv_id").sortWithinPartitions("conv_id", "task", "seq").mapInArrow(chain, "of_task int, of_seq long, before binary")
    known = parts.join(ends, (F.col("task") == F.col("of_task")) & (F.col("seq") == F.col("of_seq")))
    walked = known.select("conv_id", "task", "seq", "stated", "texts", "seen", "before")
    walked = walked.mapInArrow(walk, "conv_id long, task int, seq long, stated array<string>, texts array<string>, last binary, back binary, ways binary")
    joined = walked.repartition("conv_id").sortWithinPartitions("conv_id", "task", "seq").mapInArrow(join, _OUT)
    return cuts.where("task IS NULL").select(*joined.columns).unionByName(joined)


_KINDS = {"l": pa.int64(), "i": pa.int32(), "s": pa.string(), "b": pa.binary(), "a": pa.list_(pa.string())}


def _schema(names: str, kinds: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[k]) for n, k in zip(names.split(), kinds)])


_PIECES = ("task", "seq", "stated", "texts", "seen", "opening", "through")
_PIECE_SQL = "task int, seq long, stated array<string>, texts array<string>, seen binary, opening binary, through binary"
_OUTPUT = _schema("conv_id n_turns n_lines n_recovered n_agree roles unseen_roles rendered", "lllllsss")
_PIECE = _schema("conv_id n_turns n_lines n_recovered n_agree roles unseen_roles rendered " + " ".join(_PIECES), "lllllsssilaabbb")
_BEFORE = _schema("of_task of_seq before", "ilb")
_WALKED = _schema("conv_id task seq stated texts last back ways", "lilaabbb")


def _filled(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """batch with the columns of schema that it hasn't got, all null."""
    none = [pa.nulls(batch.num_rows, f.type) for f in schema if f.name not in batch.schema.names]
    return pa.RecordBatch.from_arrays([*batch.columns, *none], schema=schema)
