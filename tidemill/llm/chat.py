"""Chat formatting in budgeted windows.

A turn's tokens are one for its mark and those of its text, where a run of up to 12 letters and digits of
words in ASCII counts as one and every other character but white space as one. Sums of turn tokens cut a
conversation at turns: a window begins with the system turn, repeats the turns just before it as far as
`history` tokens reach, and takes own turns as long as all together keep to `budget`. Where its first own
turn would not fit, history shrinks, and then the system turn is left out. The loss mask covers assistant
turns of its own only, so repeated targets are masked and every assistant text is learnt once. A turn is
never cut: one of more than `budget` tokens is a window by itself, and `over` says so.

Template: `<|role|>\\n` text `<|end|>\\n`. In texts and roles `<|` becomes `<\\|`, and `<\\`*n`|` gets one more
backslash, which is undone by taking one away: no text can hold a mark, and nothing is lost.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.components import stored

BUDGET = 1024
HISTORY = 256
#: What counts as one token: a run of up to 12 ASCII letters and digits, or any other character.
TOKEN = r"[A-Za-z0-9]{1,12}|[^A-Za-z0-9\x20\x09-\x0D]"
_END = "<|end|>\n"
_TURN = re.compile(r"<\|((?:(?!\|>).)*?)\|>\n(.*?)<\|end\|>\n", re.S)


def escaped(column):
    return F.regexp_replace(column, r"<(\\*)\|", r"<\\$1|")


def _escaped_role(column):
    """A role's mark also ends inside the role's own line, so its closing is escaped too."""
    return F.regexp_replace(escaped(column), r"\|(\\*)>", r"|\\$1>")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _unescape_role(text: str) -> str:
    return unescape(re.sub(r"\|\\(\\*)>", r"|\1>", text))


def _text(name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _spans(budget: int, history: int):
    """Windows of turns that stream in order: of a conversation, only the last `history` tokens are held."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: object = run
        past: deque[tuple[int, int]] = deque()
        window = used = system = held = 0
        for batch in batches:
            out = []
            for c, seq, tokens, is_system in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "seq", "tokens", "is_system"))):
                if c != conv:
                    conv, window, used, held, system = c, 0, 0, 0, tokens if is_system else 0
                    past.clear()
                if seq and used + tokens > budget:
                    window += 1
                    lead = system if system + tokens <= budget else 0
                    room, used, repeats = min(history, budget - lead - tokens), lead, []
                    for s, n in reversed(past):
                        if n > room:
                            break
                        room, used = room - n, used + n
                        repeats.append(s)
                    out += [(c, s, window, False, bool(lead)) for s in reversed(repeats)]
                    with_system = bool(lead)
                elif not seq:
                    with_system = False
                used += tokens
                out.append((c, seq, window, True, with_system))
                if not is_system:
                    past.append((seq, tokens))
                    held += tokens
                    while past and held - past[0][1] >= history:
                        held -= past.popleft()[1]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()))], names=["conv_id", "seq", "window", "own", "with_system"])

    return run


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, window, first_own, text, loss, tokens, over): formatted windows and their loss spans.

    loss: (begin, end) code points in `text`, ends exclusive, of each assistant text of the window's own.
    Turns stand by turn number; equal ones by role, then text, so repeated rows stay, next to each other.
    A null turn number comes first, a null role or text is empty, rows of a null conv_id are one
    conversation of its own. tokens: of the whole window; over: they exceed the budget, which only a single
    turn of more than the budget does. A window's first turns are repeats up to `first_own`. Empty tables give no
    rows. The system turn is a conversation's first row if its role is `system`.
    """
    if not 0 <= history <= budget:
        raise ValueError("history must be between 0 and the budget")
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), _text(role_col).alias("role"), _text(text_col).alias("text"))
    rows = rows.withColumn("tokens", F.regexp_count(F.col("text"), F.lit(TOKEN)).cast("long") + 1)
    order = ["turn", "role", "text"]
    rows = stored(rows.withColumn("seq", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)) - 1), "turns")
    system = (F.col("seq") == 0) & (F.col("role") == "system")
    sized = rows.select("conv_id", F.col("seq").cast("long").alias("seq"), "tokens", system.alias("is_system"))
    used = sized.repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(_spans(budget, history), "conv_id long, seq long, window long, own boolean, with_system boolean")
    full = used.join(rows, (used.conv_id.eqNullSafe(rows.conv_id)) & (used.seq == rows.seq)).select(used.conv_id, used.seq, "window", "own", "with_system", "role", "text", "tokens")

    formatted = F.concat(F.lit("<|"), _escaped_role(F.col("role")), F.lit("|>\n"), escaped(F.col("text")), F.lit(_END))
    piece = F.struct("seq", formatted.alias("part"), (F.length(_escaped_role(F.col("role"))) + 5).alias("text_from"), F.length(escaped(F.col("text"))).alias("text_size"), ((F.col("role") == "assistant") & F.col("own")).alias("learnt"), "own")
    grouped = full.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(piece)).alias("parts"), F.sum("tokens").alias("tokens"), F.max("with_system").alias("with_system"))
    first_turn = rows.filter("seq = 0 and role = 'system'").select(F.col("conv_id").alias("c"), formatted.alias("system"), F.col("tokens").alias("system_tokens"))
    grouped = grouped.join(first_turn, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    lead = F.when(F.col("with_system"), F.col("system")).otherwise(F.lit(""))
    grouped = grouped.withColumn("tokens", F.col("tokens") + F.when(F.col("with_system"), F.col("system_tokens")).otherwise(0))
    grouped = grouped.withColumn("lead", lead)
    start = F.struct(F.length("lead").cast("int").alias("at"), F.array().cast("array<struct<begin: int, end: int>>").alias("spans"))

    def add(state, p):
        span = F.struct((state["at"] + p["text_from"]).cast("int").alias("begin"), (state["at"] + p["text_from"] + p["text_size"]).cast("int").alias("end"))
        return F.struct((state["at"] + F.length(p["part"])).cast("int").alias("at"), F.when(p["learnt"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    loss = F.aggregate("parts", start, add)["spans"]
    repeats = F.size(F.filter("parts", lambda p: ~p["own"])) + F.when(F.col("lead") != "", 1).otherwise(0)
    return grouped.select("conv_id", "window", repeats.cast("int").alias("first_own"), F.concat("lead", F.array_join(F.transform("parts", lambda p: p["part"]), "")).alias("text"), loss.alias("loss"), "tokens", (F.col("tokens") > budget).alias("over"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from windows.

    Windows of a conversation stream through one task in order, each parsed and dropped: a digest of a
    whole conversation is one chain, but no conversation is held.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, out = None, []

        def close():
            out.append((state["conv"], state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"]))

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], schema=schema) if out else None
            out.clear()
            return batch

        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        for batch in batches:
            for conv, text, loss, first_own in zip(batch.column("conv_id").to_pylist(), batch.column("text").to_pylist(), batch.column("loss").to_pylist(), batch.column("first_own").to_pylist()):
                if state is None or state["conv"] != conv:
                    if state is not None:
                        close()
                    state = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0}
                state["chars"] += len(text)
                for k, m in enumerate(_TURN.finditer(text)):
                    if k >= first_own:
                        state["n"] += 1
                        state["turns"].update(f"{_unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
                for span in loss:
                    learnt = unescape(text[span["begin"] : span["end"]])
                    state["loss_chars"] += len(learnt)
                    state["loss"].update(learnt.encode())
            if out and (done := flush()):
                yield done
        if state is not None:
            close()
            yield flush()

    ordered = formatted.select("conv_id", "window", "first_own", "text", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
