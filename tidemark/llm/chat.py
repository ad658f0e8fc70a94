"""Chat transcripts: who speaks is recovered by a hidden Markov model over lines, then turns are rendered canonically.

A line's hidden state is a role and whether the line opens a turn. What is seen of it is its speaker marker (a known role
word, an unknown name, none), whether blank lines came before, whether it asks a question and its length class. Transitions
between roles, how conversations begin and end, each role's opening lines and its number of lines are counted over a table of
labelled turns; how markers relate to states is fixed. Whether blank lines part turns or paragraphs is decided for a transcript
as a whole, by the likelier path. So is which role each unknown name has, or that it is no speaker but text: all assignments
are tried of the three most frequent names, further ones are then judged one after the other, again and again until none
changes. Viterbi search gives each line's state; opening lines split the transcript into turns.

Defined results: a null or blank transcript has no turns, and a turn without text is none; text before the first marker is a
turn of the likeliest role; role words in any case and the usual decorations are markers; a speaker's marker that is repeated
within its turn is left out, a line that only looks marked stays as it is; the names of speakers are returned beside their
roles; transcripts and turns of any number and length are read whole; a null id is carried; repeated transcripts are parsed row
by row; an empty table gives an empty result; extra columns are ignored, whatever their names. Labelled turns without a known
role teach nothing, those without a number neither begin nor follow; of turns repeated under one number each counts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant", "tool")
#: Words that name a role.
WORDS = {
    "system": "system", "sys": "system", "instruction": "system", "instructions": "system", "developer": "system",
    "user": "user", "human": "user", "prompter": "user", "question": "user", "q": "user", "customer": "user", "you": "user", "me": "user", "input": "user",
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "chatbot": "assistant", "model": "assistant", "gpt": "assistant", "answer": "assistant", "a": "assistant", "agent": "assistant", "response": "assistant", "output": "assistant",
    "tool": "tool", "function": "tool", "observation": "tool", "ipython": "tool",
}
#: Forms of markers; group 1 is the speaker, what follows the match is the turn's text.
FORMS = (
    re.compile(r"^\s*<\|(?:im_start|start_header_id)\|>\s*(\w+)\s*(?:<\|end_header_id\|>)?\s*"),
    re.compile(r"^\s*<\|(\w+)\|>\s*"),
    re.compile(r"^\s*#{1,4}\s*([A-Za-z][\w .-]{0,24}?)\s*:?\s*$"),
    re.compile(r"^\s*#{1,4}\s*([A-Za-z][\w .-]{0,24}?)\s*:\s*"),
    re.compile(r"^\s*\*\*\s*([A-Za-z][\w .-]{0,24}?)\s*:?\s*\*\*\s*:?\s*"),
    re.compile(r"^\s*\[\s*([A-Za-z][\w .-]{0,24}?)\s*\]\s*:?\s*"),
    re.compile(r"^\s*(?:\(?\d{1,2}:\d{2}(?::\d{2})?\)?\s*)?<?([A-Za-z][\w.-]{0,20}(?: [A-Z][\w.-]{0,20})?)>?\s*:(?:\s+|$)"),
)
END = re.compile(r"\s*<\|(?:im_end|eot_id|end|eom_id)\|>\s*$|^\s*</s>\s*$")
#: Log probabilities of what is seen given the state: fixed.
SURE, AT_TIMES, OWN, RARE, NEVER = math.log(0.9), math.log(0.2), math.log(0.05), math.log(0.01), math.log(1e-6)
AGAINST = -1e6  # a role word means its role
#: Against a name that comes only once being a speaker's, where other names recur and where others are marked by role words.
ONCE, ONCE_AMONG_WORDS = 3.0, 8.0
TRIED = 3  # names whose assignments are all tried
BEGIN, END_OF = "", "end"


def marker(line: str) -> tuple[str | None, str]:
    """The speaker's name in lower case, if the line starts with a marker, and the rest of the line."""
    for i, form in enumerate(FORMS):
        if (m := form.match(line)) and (i == len(FORMS) - 1 or m[1].lower().split()[0] in WORDS):
            return m[1].lower().strip(), line[m.end() :]
    return None, line


def feature(line: str) -> int:
    """0 to 5: length class, and whether it asks."""
    n = len(line.split())
    return (0 if n < 8 else 1 if n < 40 else 2) * 2 + line.rstrip().endswith("?")


class Model:
    """Log probabilities: ``step`` from a role (or the beginning) to the next one (or the end), ``look`` of an opening line's
    features, ``more`` and ``last`` of another line and of none within a turn."""

    def __init__(self, steps: dict[tuple[str, str], float], looks: dict[tuple[str, int], float], sizes: dict[str, tuple[float, float]]):
        """Counts; ``sizes`` has each role's turns and lines."""

        def logs(table: dict, key, others) -> dict:
            total = sum(table.get((key, o), 0) + 0.5 for o in others)
            return {o: math.log((table.get((key, o), 0) + 0.5) / total) for o in others}

        self.step = {a: logs(steps, a, (*ROLES, END_OF) if a else ROLES) for a in (BEGIN, *ROLES)}
        # tempered: what a role talks like in one table says little about another
        self.look = {a: {f: p / 4 for f, p in logs(looks, a, range(6)).items()} for a in ROLES}
        self.more, self.last = {}, {}
        for a in ROLES:
            turns, lines = sizes.get(a, (0, 0))
            share = (lines - turns + 0.5) / (lines + 1)
            self.more[a], self.last[a] = math.log(share) / 2, math.log(1 - share) / 2


def learn(turns: DataFrame) -> Model:
    """Counts over all labelled turns (conv_id, turn, role, text). A turn's neighbours are found by its number."""
    known = turns.filter(F.col("role").isin(*ROLES)).select("conv_id", "turn", "role", "text")
    numbered = known.select("conv_id", "turn", "role")
    near = lambda by, name: numbered.select("conv_id", (F.col("turn") + by).alias("turn"), F.col("role").alias(name))
    count = lambda df, *by: df.groupBy(*by).count().collect()
    steps: Counter = Counter()
    for r in count(numbered.join(near(1, "was"), ["conv_id", "turn"], "left"), F.coalesce("was", F.lit(BEGIN)).alias("was"), "role"):
        steps[r["was"], r["role"]] += r["count"]
    for r in count(numbered.join(near(-1, "next"), ["conv_id", "turn"], "left_anti"), "role"):
        steps[r["role"], END_OF] += r["count"]
    text = F.coalesce("text", F.lit(""))
    first = F.substring_index(text, "\n", 1)
    n = F.regexp_count(first, F.lit("\\S+"))
    seen = (F.when(n < 8, 0).when(n < 40, 1).otherwise(2) * 2 + F.endswith(F.rtrim(first), F.lit("?")).cast("int")).alias("f")
    looks, sizes = {}, {}
    lines = F.sum(F.regexp_count(text, F.lit("\n")) + 1).alias("lines")
    for r in known.groupBy("role", seen).agg(F.count(F.lit(1)).alias("count"), lines).collect():
        looks[r["role"], r["f"]] = r["count"]
        before = sizes.get(r["role"], (0, 0))
        sizes[r["role"]] = before[0] + r["count"], before[1] + r["lines"]
    return Model(steps, looks, sizes)


class _Line:
    """A line that isn't blank: its marker's name, the text after it, the line as it stands, and whether blank ones came before."""

    __slots__ = ("gap", "look", "name", "raw", "text")

    def __init__(self, name: str | None, text: str, raw: str, gap: bool):
        self.name, self.text, self.raw, self.gap, self.look = name, text, raw, gap, feature(text)


def _role(name: str | None, names: dict[str, str | None]) -> str | None:
    return (WORDS.get(name.split()[0]) or names.get(name)) if name else None


def _path(lines: list[_Line], names: dict[str, str | None], parts: bool, model: Model) -> tuple[float, tuple]:
    """The likeliest states (role, opens) of lines as a linked list, and their log probability. ``parts``: blank lines part turns."""
    best: dict[str, tuple[float, tuple]] = {}
    for i, line in enumerate(lines):
        told = _role(line.name, names)
        after: dict[str, tuple[float, tuple]] = {}
        opens = SURE if told or not i else (SURE if parts else RARE) if line.gap else NEVER
        for role in ROLES:
            if i:
                p, path = max(((p + model.last[was] + model.step[was][role], path) for was, (p, path) in best.items()), key=lambda x: x[0])
            else:
                p, path = model.step[BEGIN][role], ()
            p += opens + model.look[role][line.look] + (AGAINST if told and told != role else 0.0)
            after[role] = (p, (path, role, True))
            if i:
                # a speaker's own marker may be repeated within its turn, another's never stands there
                stays = (OWN if told == role else AGAINST) if told else RARE if line.name or (line.gap and parts) else AT_TIMES if line.gap else 0.0
                if (q := best[role][0] + stays + model.more[role]) > p:
                    after[role] = (q, (best[role][1], role, False))
        best = after
    return max(((p + model.last[role] + model.step[role][END_OF], path) for role, (p, path) in best.items()), key=lambda x: x[0])


def _states(lines: list[_Line], model: Model) -> tuple[dict[str, str | None], list[tuple[str, bool]]]:
    """The unknown names' roles, and the lines' states."""
    seen = Counter(x.name for x in lines if x.name and x.name.split()[0] not in WORDS)
    doubt = ONCE_AMONG_WORDS if sum(_role(x.name, {}) in ("user", "assistant") for x in lines) > 1 else ONCE if max(seen.values(), default=0) > 1 else 0.0
    # without any marker, blank lines are all there is to part turns
    gaps = (True,) if not any(x.name for x in lines) else (False, True) if any(x.gap for x in lines) else (False,)

    def judged(names: dict[str, str | None]) -> tuple[float, tuple, dict[str, str | None]]:
        p, path = max((_path(lines, names, parts, model) for parts in gaps), key=lambda x: x[0])
        return p - sum(doubt for n, role in names.items() if role and seen[n] == 1), path, names

    often = sorted(seen, key=lambda n: -seen[n])
    rest = dict.fromkeys(often[TRIED:])
    best = max((judged(dict(zip(often, roles, strict=False)) | rest) for roles in product((*ROLES[:3], None), repeat=min(TRIED, len(often)))), key=lambda x: x[0])
    while rest:
        before = best[0]
        for n in often:
            best = max((best, *(judged(best[2] | {n: role}) for role in (*ROLES[:3], None) if role != best[2][n])), key=lambda x: x[0])
        if best[0] <= before:
            break
    _, path, names = best
    states = []
    while path:
        path, role, new = path
        states.append((role, new))
    return names, states[::-1]


def _lines(transcript: str) -> Iterator[_Line]:
    gap, open_ = False, None  # a marker alone on its line belongs to the text below
    for raw in transcript.split("\n"):
        name, text = marker(raw)
        text = END.sub("", text)
        if open_ and not name and text.strip():
            yield _Line(open_[0], text, f"{open_[1]}\n{raw}", open_[2])
            open_ = gap = None
        elif name and not text.strip():
            if open_:
                yield _Line(open_[0], "", open_[1], open_[2])
            open_, gap = (name, raw, bool(gap)), None
        elif not name and not text.strip():
            gap = True
        else:
            if open_:
                yield _Line(open_[0], "", open_[1], open_[2])
            yield _Line(name, text, END.sub("", raw), bool(gap))
            open_ = gap = None
    if open_:
        yield _Line(open_[0], "", open_[1], open_[2])


def read(transcript: str | None, model: Model) -> list[tuple[str, str, str]]:
    """The turns (role, speaker's name as marked or empty, text) of a transcript."""
    lines = list(_lines(transcript or ""))
    if not lines:
        return []
    names, states = _states(lines, model)
    turns: list[tuple[str, str, list[str]]] = []
    for line, (role, new) in zip(lines, states, strict=True):
        own = not line.name or _role(line.name, names) == role
        text = line.text if own else line.raw
        if new:
            turns.append((role, line.name or "" if own else "", [text]))
        else:
            turns[-1][2].extend(["", text] if line.gap and not (own and line.name) else [text])
    return [(role, name, text) for role, name, part in turns if (text := "\n".join(part).strip("\n").rstrip())]


def parse(transcript: str | None, model: Model) -> list[tuple[str, str]]:
    """The turns (role, text) of a transcript."""
    return [(role, text) for role, _, text in read(transcript, model)]


def render(turns: list[tuple[str, str]]) -> str:
    """The canonical form."""
    return "".join(f"<|im_start|>{role}\n{text}<|im_end|>\n" for role, text in turns)


def format_transcripts(transcripts: DataFrame, model: Model, key: str = "conv_id", text: str = "transcript") -> DataFrame:
    """``key``, n_turns, roles and speakers (joined by commas) and rendered of every row."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [read(t.as_py(), model) for t in b.column(1)]
            cols = [b.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([",".join(r for r, _, _ in x) for x in found], pa.string()),
                    pa.array([",".join(n for _, n, _ in x) for x in found], pa.string()), pa.array([render([(r, t) for r, _, t in x]) for x in found], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [key, "n_turns", "roles", "speakers", "rendered"])

    kind = transcripts.select(key).dtypes[0][1]
    return transcripts.select(key, text).mapInArrow(parsed, f"{key} {kind}, n_turns long, roles string, speakers string, rendered string")


#: Names that stand for user and assistant in transcripts of the third style, by pairs.
NAMES = (("Maren", "Oskar"), ("Dr. Lindqvist", "Pia"), ("Tomás", "Yuki"), ("guest_17", "helpdesk"))


def transcripts(turns: DataFrame) -> DataFrame:
    """(conv_id, transcript) of labelled turns, one row a conversation, written as people and programs would, in a style by
    conversation: other words for the roles, repeated on every line; names that say nothing of the roles; blank lines instead of
    markers, but for system and tool turns; every third marker missing, the last one apart; tags."""
    style, pair = F.pmod(F.xxhash64("conv_id"), F.lit(5)), F.pmod(F.xxhash64("conv_id", F.lit(1)), F.lit(len(NAMES)))
    body, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    capital = F.initcap(role)
    word = F.when(role == "user", F.lit("Human")).when(role == "assistant", F.lit("AI")).otherwise(capital)
    pick = lambda at: F.element_at(F.array(*[F.lit(n[at]) for n in NAMES]), pair.cast("int") + 1)
    name = F.when(role == "user", pick(0)).when(role == "assistant", pick(1)).otherwise(capital)
    said = role.isin("user", "assistant")
    line = (
        F.when(style == 0, F.concat(word, F.lit(": "), F.replace(body, F.lit("\n"), F.concat(F.lit("\n"), word, F.lit(": ")))))
        .when(style == 1, F.concat(name, F.lit(": "), body))
        .when(style == 2, F.concat(F.when(said, F.lit("")).otherwise(F.concat(capital, F.lit(": "))), body))
        .when(style == 3, F.concat(F.lit("### "), capital, F.lit(":\n"), body))
        .otherwise(F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), body, F.lit("<|im_end|>")))
    )
    rows = turns.select("conv_id", style.alias("style"), F.struct("turn", line.alias("line"), body.alias("bare")).alias("l"))
    grouped = rows.groupBy("conv_id", "style").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    # a last turn without a marker couldn't be told from a paragraph
    unmarked = lambda i: (F.col("style") == 3) & (i % 3 == 2) & (i < F.size("ls") - 1)
    lines = F.transform("ls", lambda x, i: F.when(unmarked(i), x["bare"]).otherwise(x["line"]))
    return grouped.select("conv_id", F.when(F.col("style").isin(2, 3), F.array_join(lines, "\n\n")).otherwise(F.array_join(lines, "\n")).alias("transcript"))
