"""Chat formatting: transcripts parsed by a hidden Markov model, then rendered turn by turn.

A transcript is rows of text in order (``conv_id``, ``turn``); its lines say who speaks by markers in many styles, or do
not. States are a role with the first line of a turn or a further one. A line is seen as a symbol: whose marker it
starts with, whether a blank line precedes it, whether it ends as a question, and its length. Transition and symbol
probabilities are counted over labelled conversations; Viterbi finds the likeliest states, and turns are rendered in one
canonical form.

Lines are range-partitioned by conversation and place, so a conversation of any length is spread evenly. A conversation
that spans partitions is decoded exactly: each of its runs gives the best score between any two states, the runs'
matrices (at most two per partition) fix the states at the seams, and then each run is decoded by itself.

Defined cases: null text is an empty line; a null conv_id is a conversation of its own; null or unknown roles teach
nothing; rows that repeat (conv_id, turn) are lines one after the other; an empty table gives an empty result; other
columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import stage

ROLES = ("system", "user", "assistant")
#: States: first lines of the three roles, then further lines.
STATES = 2 * len(ROLES)
SPEAKERS = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "customer", "question", "client", "prompter", "me", "q"),
    "assistant": ("assistant", "ai", "agent", "answer", "bot", "model", "gpt", "support", "a"),
}
#: How transcripts are written in the wild: what stands before a turn, per role.
STYLES = (
    ("System: ", "User: ", "Assistant: "),
    ("### Instructions:\n", "### Human:\n", "### Assistant:\n"),
    ("[system] ", "[user] ", "[assistant] "),
    ("Context - ", "Q: ", "A: "),
    ("**System**: ", "**Customer**: ", "**Agent**: "),
)
#: Upper bounds of line lengths that are told apart.
LENGTHS = (20, 80, 240)
SYMBOLS = 1 + (len(ROLES) + 1) * 2 * 2 * (len(LENGTHS) + 1)
LINES = "conv_id", "turn", "line_no"


def _marker(role: str) -> str:
    return rf"^[\s#>*\[<(|-]{{0,8}}(?i:{'|'.join(SPEAKERS[role])})(?:[\]>)*|]{{1,4}}\s*[:-]?|\s*:|\s+-)(?:\s|$)"


MARKERS = tuple(_marker(role) for role in ROLES)


def transcribed(conversations: DataFrame) -> DataFrame:
    """Conversations as transcripts: one style per conversation, and every seventh turn without its marker.

    Returns conv_id, turn, role (the truth), text (raw lines, a blank one before each turn).
    """
    style = F.pmod(F.hash("conv_id"), F.lit(len(STYLES)))
    marks = F.create_map(*[x for i, s in enumerate(STYLES) for r, m in zip(ROLES, s) for x in (F.lit(f"{i} {r}"), F.lit(m))])
    bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(7)) == 0
    mark = F.when(bare, "").otherwise(F.coalesce(marks[F.concat_ws(" ", style, "role")], F.lit("")))
    return conversations.select("conv_id", "turn", "role", F.concat(F.lit("\n"), mark, F.coalesce("text", F.lit(""))).alias("text"))


def _symbol(line: Column, after_blank: Column) -> Column:
    """0 for a blank line, else a number made of the line's features."""
    speaker = F.lit(0)
    for i, marker in reversed(list(enumerate(MARKERS, 1))):
        speaker = F.when(line.rlike(marker), i).otherwise(speaker)
    bucket = sum((F.length(line) > n).cast("int") for n in LENGTHS)
    asks = line.rlike(r"\?\s*$").cast("int")
    return F.when(F.trim(line) == "", 0).otherwise(1 + ((speaker * 2 + after_blank.cast("int")) * 2 + asks) * (len(LENGTHS) + 1) + bucket)


def lines(transcripts: DataFrame, partitions: int | None = None) -> DataFrame:
    """conv_id, turn, line_no, line, symbol, truth (state or null), part: in order, evenly partitioned, on shared storage."""
    split = F.split(F.coalesce("text", F.lit("")), r"\r?\n")
    told = F.array_position(F.array(*map(F.lit, ROLES)), F.coalesce("role", F.lit(""))) - 1 if "role" in transcripts.columns else F.lit(-1)
    rows = transcripts.select("conv_id", "turn", told.alias("told"), split.alias("all")).select(
        "conv_id", "turn", "told", "all", F.posexplode("all").alias("line_no", "line"))
    after = (F.col("line_no") == 0) | (F.trim(F.element_at("all", F.greatest(F.col("line_no"), F.lit(1)))) == "")
    # a turn begins at its first line with something in it
    first = F.expr("array_position(transform(all, x -> trim(x) != ''), true)") - 1
    begins = F.col("line_no") == F.greatest(first, F.lit(0))
    truth = F.when(F.col("told") >= 0, F.when(begins, F.col("told")).otherwise(F.col("told") + len(ROLES)))
    rows = rows.select(*LINES, "line", _symbol(F.col("line"), after).alias("symbol"), truth.cast("int").alias("truth"),
                       (F.col("line_no") < first).alias("lead"))
    # blank lines before a turn's first words belong to the turn before it
    rows = rows.withColumn("truth", F.when(F.col("lead"), F.lit(None)).otherwise(F.col("truth"))).drop("lead")
    n = partitions or int(transcripts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(rows.repartitionByRange(n, *LINES).sortWithinPartitions(*LINES).withColumn("part", F.spark_partition_id()))


@dataclass(frozen=True)
class Chain:
    """Log probabilities: of a first state, of a step, of a symbol in a state."""
    start: np.ndarray
    step: np.ndarray
    symbol: np.ndarray


def _logs(counts: np.ndarray, weight: float) -> np.ndarray:
    counts = counts + weight
    return np.log(counts / counts.sum(-1, keepdims=True))


def fit(rows: DataFrame) -> Chain:
    """Counts over the labelled lines of ``lines``; blank lines between turns are left out of the steps."""
    known = rows.where("truth IS NOT NULL")
    order = Window.partitionBy("part", "conv_id").orderBy("turn", "line_no")
    steps = known.select("truth", F.lead("truth").over(order).alias("then")).where("then IS NOT NULL").groupBy("truth", "then").count()
    # a conversation's runs in two partitions meet here: one row per run
    place = F.struct("turn", "line_no")
    ends = known.groupBy("conv_id", "part").agg(F.min_by("truth", place).alias("first"), F.max_by("truth", place).alias("last"))
    runs = Window.partitionBy("conv_id").orderBy("part")
    seams = ends.select("first", "last", F.lead("first").over(runs).alias("then"), F.row_number().over(runs).alias("nth"))
    a, pi, b = np.zeros((STATES, STATES)), np.zeros(STATES), np.zeros((STATES, SYMBOLS))
    for r in steps.unionByName(seams.where("then IS NOT NULL").groupBy(F.col("last").alias("truth"), "then").count()).collect():
        a[r["truth"], r["then"]] += r["count"]
    for r in seams.where("nth = 1").groupBy("first").count().collect():
        pi[r["first"]] = r["count"]
    for r in known.groupBy("truth", "symbol").count().collect():
        b[r["truth"], r["symbol"]] = r["count"]
    # a conversation begins with a first line, or with blank lines that belong to no turn
    start = np.append(_logs(pi[:len(ROLES)], 1.0), np.full(len(ROLES), -20.0))
    a, b = _logs(a, 0.01), _logs(b, 0.1)
    for i in range(STATES):  # a further line belongs to the turn before it, and a blank line begins none
        for j in range(len(ROLES), STATES):
            if j % len(ROLES) != i % len(ROLES):
                a[i, j] = -1e9
    b[:len(ROLES), 0], b[len(ROLES):, 0] = -1e3, 0.0
    return Chain(start, a, b)


def _matrix(chain: Chain, symbols: np.ndarray) -> np.ndarray:
    """Best score of a run from the state before it (rows) to its last state (columns)."""
    m = np.full((STATES, STATES), -np.inf)
    np.fill_diagonal(m, 0.0)
    for s in symbols:
        m = (m[:, :, None] + chain.step[None]).max(1) + chain.symbol[:, s]
    return m


def _viterbi(chain: Chain, symbols: np.ndarray, before: int | None, last: int | None) -> np.ndarray:
    """Likeliest states of a run; ``before``: the state ahead of it, ``last``: the state it ends in, where known."""
    score = (chain.start if before is None else chain.step[before]) + chain.symbol[:, symbols[0]]
    back = np.zeros((len(symbols), STATES), dtype=np.int8)
    for i in range(1, len(symbols)):
        paths = score[:, None] + chain.step
        back[i] = paths.argmax(0)
        score = paths.max(0) + chain.symbol[:, symbols[i]]
    states = np.empty(len(symbols), dtype=np.int32)
    states[-1] = score.argmax() if last is None else last
    for i in range(len(symbols) - 1, 0, -1):
        states[i - 1] = back[i, states[i]]
    return states


def _runs(batches):
    """The runs of one conversation each in a partition's ordered batches."""
    held: list[pd.DataFrame] = []
    for frame in batches:
        key = frame["conv_id"].fillna(-1).to_numpy()
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(frame) else []
        for a, b in zip(starts, [*starts[1:], len(frame)]):
            piece = frame.iloc[a:b]
            if held and (pd.isna(held[-1]["conv_id"].iloc[0]) != pd.isna(piece["conv_id"].iloc[0]) or key[a] != held[-1]["conv_id"].fillna(-1).iloc[0]):
                yield pd.concat(held)
                held = []
            held.append(piece)
    if held:
        yield pd.concat(held)


def _seams(chain: Chain, runs: list[tuple]) -> dict:
    """State before and at the end of every run of the conversations that have several: (conv_id, part) -> states."""
    by: dict = {}
    for conv, part, m in sorted(runs, key=lambda r: r[1]):
        by.setdefault(conv, []).append((part, np.array(m).reshape(STATES, STATES)))
    out = {}
    for conv, parts in by.items():
        # the first run starts anew: its matrix has the start's row in every row
        score, back = None, []
        for part, m in parts:
            paths = m[0][None] if score is None else score[:, None] + m
            back.append(paths.argmax(0))
            score = paths.max(0)
        last = int(score.argmax())
        for i in range(len(parts) - 1, -1, -1):
            before = int(back[i][last]) if i else None
            out[conv, parts[i][0]] = (before, last)
            last = before
    return out


def decode(rows: DataFrame, chain: Chain) -> DataFrame:
    """``rows`` of ``lines`` with ``state`` and ``turn_no`` (the recovered turn, from 0 in its conversation)."""
    spark = rows.sparkSession
    # at most one conversation goes on from a partition into the next
    spanning = stage(rows.groupBy("conv_id").agg(F.min("part").alias("first_part"), F.max("part").alias("last_part")).where("first_part < last_part"))

    def matrices(batches):
        for run in _runs(batches):
            symbols = run["symbol"].to_numpy()
            if run["part"].iloc[0] == run["first_part"].iloc[0]:
                first = chain.start + chain.symbol[:, symbols[0]]
                m = (first[:, None] + _matrix(chain, symbols[1:])).max(0)
                m = np.tile(m, (STATES, 1))
            else:
                m = _matrix(chain, symbols)
            conv = run["conv_id"].iloc[0]
            yield pd.DataFrame({"conv_id": [None if pd.isna(conv) else conv], "part": [run["part"].iloc[0]], "m": [m.ravel().tolist()]})

    side = spanning.select(F.col("conv_id").alias("s_conv"), "first_part")
    split = rows.join(F.broadcast(side), F.col("conv_id").eqNullSafe(F.col("s_conv"))).select("conv_id", "part", "symbol", "first_part")
    found = split.mapInPandas(matrices, "conv_id long, part int, m array<double>").collect()  # two rows per partition at most
    seams = _seams(chain, [(r["conv_id"], r["part"], r["m"]) for r in found])

    def states(batches):
        for run in _runs(batches):
            conv = run["conv_id"].iloc[0]
            before, last = seams.get((None if pd.isna(conv) else int(conv), int(run["part"].iloc[0])), (None, None))
            found = _viterbi(chain, run["symbol"].to_numpy(), before, last)
            yield run.assign(state=found, in_run=np.cumsum(found < len(ROLES)).astype("int64"))

    done = stage(rows.drop("truth").mapInPandas(states, "conv_id long, turn long, line_no int, line string, symbol int, part int, state int, in_run long"))
    # turns of earlier runs of the same conversation: two rows per partition at most
    own = done.join(F.broadcast(side), F.col("conv_id").eqNullSafe(F.col("s_conv"))).groupBy("s_conv", "part").agg(F.max("in_run").alias("n"))
    earlier = Window.partitionBy("s_conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    own = own.select("s_conv", F.col("part").alias("s_part"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    out = done.join(F.broadcast(own), F.col("conv_id").eqNullSafe(F.col("s_conv")) & (F.col("part") == F.col("s_part")), "left")
    return out.select("conv_id", "turn", "line_no", "line", "state", (F.col("in_run") + F.coalesce("ahead", F.lit(0)) - 1).alias("turn_no"))


def turns(decoded: DataFrame) -> DataFrame:
    """One row per recovered turn: conv_id, turn_no, role, text (markers and outer blank lines gone), rendered."""
    line = F.col("line")
    for marker in MARKERS:
        line = F.regexp_replace(line, marker, "")
    line = F.when(F.col("state") < len(ROLES), line).otherwise(F.col("line"))
    placed = decoded.where((F.col("turn_no") >= 0) | (F.trim("line") != "")).withColumn("turn_no", F.greatest("turn_no", F.lit(0).cast("long")))
    rows = placed.groupBy("conv_id", "turn_no").agg(
        F.min("state").alias("state"), F.sort_array(F.collect_list(F.struct("turn", "line_no", line.alias("line")))).alias("parts"))
    role = F.element_at(F.array(*map(F.lit, ROLES)), F.pmod("state", F.lit(len(ROLES))) + 1)
    text = F.regexp_replace(F.array_join("parts.line", "\n"), r"^\s+|\s+$", "")
    out = rows.select("conv_id", "turn_no", role.alias("role"), text.alias("text"))
    return out.withColumn("rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>\n")))


def format_chats(transcripts: DataFrame, chain: Chain | None = None) -> DataFrame:
    """Canonical turns of ``transcripts``; the model is counted on their own roles unless one is given."""
    rows = lines(transcripts)
    return turns(decode(rows, chain or fit(rows)))
