"""Chat formatting by schema fingerprints (operator 13).

Contract.  Records are JSON objects of any known layout (``LAYOUTS``).  ``canonical(records)`` returns
their turns: ``conv_id``, ``part``, ``turn``, ``pos``, ``role``, ``text``; ``rejected(records)`` the records of no
known layout with their fingerprint and why, so that each record is in exactly one of the two.
``render(turns)`` returns a formatted piece for each turn and the code points of it that count for the
loss (an assistant's text); a conversation's formatted text is its pieces in order.  ``read_back``
parses pieces alone and returns per conversation: ``conv_id``, ``n_turns``, ``turns_sha256`` (of role, line
feed, text, line feed of every turn), ``loss_chars`` and ``loss_sha256`` (of the unescaped text
under the loss mask), ``formatted_chars``, ``part``.

Method.  The fingerprint of a record is a hash of those of its nested field paths that layouts know
(``messages[].role``); other fields do not change it.  Each layout declares which paths it needs and which it
may have; all its fingerprints are listed beforehand and select the mapping: which path is the id, and
how turns are made of a list, of single fields or of the record itself.  A Python helper finds the
paths; the mappings, escapes and marks are Spark expressions.

Escapes.  A control string inside a role or a text gets a backslash after its first sign (one more, if
some stand there), so no control string is left and taking one away gives the text back.
:class:`Template` refuses control strings that could overlap, which would make this ambiguous.

Order and scale.  Turns stand by ``turn`` (nulls first), then place in the record, then piece.  Rows of the
row layout belong to the conversation of their id (``part`` 0); every record that holds a whole
conversation is one of its own, also if ids repeat (``part`` is then a number of its own).  Formatting is done
row by row without a shuffle; reading back streams sorted pieces, so a conversation of any length takes
bounded memory, in one task because its digest is sequential.

Edge cases: null texts and roles are empty; a null id is an id of its own; repeated rows are turns each;
line feeds and backslashes in roles are escaped too; extra columns and fields are ignored; an empty table gives an
empty result; what is no JSON object, or mixes the fields of two layouts, is rejected.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

from . import scratch

#: Roles that other layouts use.
ROLE_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant"}
TURNS = "array<struct<turn:long,pos:int,role:string,text:string>>"


@dataclass(frozen=True)
class Listed:
    """Turns are the elements of a list; a text may be in several places or in parts, which are joined."""

    path: str
    role: str
    texts: tuple[str, ...]

    def turns(self, record: Column) -> Column:
        wanted = [self.role, *self.texts]
        items = F.try_variant_get(record, f"$.{self.path}", "array<variant>")

        def turn(x, i):
            role, *texts = [_text(x, p) for p in wanted]
            return F.struct(F.lit(None).cast("long").alias("turn"), i.alias("pos"), _known_role(role).alias("role"), F.coalesce(*texts, F.lit("")).alias("text"))

        return F.transform(items, turn)


@dataclass(frozen=True)
class Fields:
    """Turns are single fields; the texts of several paths are joined by an empty line."""

    turn_of: tuple[tuple[str, tuple[str, ...]], ...]

    def turns(self, record: Column) -> Column:
        made = []
        for i, (role, paths) in enumerate(self.turn_of):
            texts = F.filter(F.array(*(_text(record, p) for p in paths)), lambda t: t.isNotNull() & (t != ""))
            text = F.array_join(texts, "\n\n") if len(paths) > 1 else F.coalesce(_text(record, paths[0]), F.lit(""))
            here = F.struct(F.lit(None).cast("long").alias("turn"), F.lit(i).alias("pos"), F.lit(role).alias("role"), text.alias("text"))
            made.append(F.when(F.size(texts) > 0, here) if role == "system" else here)
        return F.filter(F.array(*made), lambda t: t.isNotNull())


@dataclass(frozen=True)
class Row:
    """The record is one turn of the conversation of its id."""

    turn: str
    role: str
    text: str

    def turns(self, record: Column) -> Column:
        role, text = (F.coalesce(_text(record, p), F.lit("")) for p in (self.role, self.text))
        return F.array(F.struct(F.try_variant_get(record, f"$.{self.turn}", "long").alias("turn"), F.lit(0).alias("pos"), role.alias("role"), text.alias("text")))


@dataclass(frozen=True)
class Layout:
    """A declarative mapping: paths that a record needs and may have, its id, and how turns are made."""

    name: str
    needs: tuple[str, ...]
    turns: Listed | Fields | Row
    may: tuple[str, ...] = ()
    ids: tuple[str, ...] = ("id",)

    def path_sets(self) -> Iterable[tuple[str, ...]]:
        """All sets of known paths that records of this layout can have."""
        extra = (*self.may, *self.ids)
        for k in range(len(extra) + 1):
            for some in itertools.combinations(extra, k):
                yield (*self.needs, *some)


_IDS = ("id", "conv_id")
_MESSAGES = Listed("messages", "role", ("content[].text", "content"))
LAYOUTS = (
    Layout("rows", ("conv_id", "turn", "role", "text"), Row("turn", "role", "text"), (), ()),
    Layout("messages", ("messages[].role", "messages[].content"), _MESSAGES, (), _IDS),
    Layout("message parts", ("messages[].role", "messages[].content[].text"), _MESSAGES, ("messages[].content", "messages[].content[].type"), _IDS),
    Layout("authors", ("messages[].author.role", "messages[].content.parts[]"), Listed("messages", "author.role", ("content.parts[]",)), (), _IDS),
    Layout("from and value", ("conversations[].from", "conversations[].value"), Listed("conversations", "from", ("value",)), (), _IDS),
    Layout("instruction", ("instruction", "output"), Fields((("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))), ("input", "system"), _IDS),
    Layout("prompt and response", ("prompt", "response"), Fields((("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))), ("system",), _IDS),
    Layout("prompt and completion", ("prompt", "completion"), Fields((("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))), ("system",), _IDS),
    Layout("question and answer", ("question", "answer"), Fields((("user", ("context", "question")), ("assistant", ("answer",)))), ("context",), _IDS),
)


def _known_role(role: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in ROLE_NAMES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, F.lower(F.coalesce(role, F.lit("")))), role, F.lit(""))


def _text(record: Column, path: str) -> Column:
    """The text at a path of a variant, or null; ``[]`` joins the texts of a list."""
    if "[]" not in path:
        return F.try_variant_get(record, f"$.{path}", "string")
    head, _, rest = path.partition("[]")
    items = F.try_variant_get(record, f"$.{head}", "array<variant>")
    parts = F.transform(items, lambda x: F.try_variant_get(x, f"${rest}" if rest else "$", "string"))
    return F.array_join(F.filter(parts, lambda t: t.isNotNull()), "")


# ---- fingerprints ---------------------------------------------------------------------------------


def fingerprint(paths: Iterable[str]) -> int:
    """A hash of a set of nested field paths."""
    return int.from_bytes(hashlib.sha256("\n".join(sorted(set(paths))).encode()).digest()[:8], "big", signed=True)


def mappings(layouts: Iterable[Layout] = LAYOUTS) -> dict[int, str]:
    """Fingerprint to layout; two layouts with one fingerprint are an error."""
    known: dict[int, str] = {}
    for layout in layouts:
        for paths in layout.path_sets():
            if known.setdefault(fingerprint(paths), layout.name) != layout.name:
                raise ValueError(f"layouts {known[fingerprint(paths)]!r} and {layout.name!r} cannot be told apart by {sorted(paths)}")
    return known


def _tree(paths: Iterable[str]) -> dict:
    root: dict = {}
    for path in paths:
        at = root
        for step in path.replace("[]", ".[]").split("."):
            at = at.setdefault(step, {})
        at[""] = path
    return root


def known_paths(record, tree: dict) -> set[str]:
    """The known nested field paths of a parsed record; fields that no layout names are not entered."""
    found: set[str] = set()
    todo = [(record, tree)]
    while todo:
        value, at = todo.pop()
        inner = [k for k in at if k]
        if isinstance(value, dict):
            todo += [(value[k], at[k]) for k in inner if k in value]
        elif isinstance(value, list):
            todo += [(x, at["[]"]) for x in value] if "[]" in at else []
        if "" in at and not (isinstance(value, (dict, list)) and inner):
            found.add(at[""])
    return found


def with_layout(records: DataFrame, layouts: Iterable[Layout] = LAYOUTS, column: str = "record") -> DataFrame:
    """Adds ``fingerprint`` (null: no JSON object) and ``layout`` (null: none has it)."""
    layouts = tuple(layouts)
    tree = _tree(p for x in layouts for paths in x.path_sets() for p in paths)

    def one(text):
        try:
            record = json.loads(text) if text is not None else None
        except (ValueError, RecursionError):
            return None
        return fingerprint(known_paths(record, tree)) if isinstance(record, dict) else None

    @F.pandas_udf(LongType())
    def mark(texts: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in texts], dtype="Int64")

    names = F.create_map(*(F.lit(x) for pair in mappings(layouts).items() for x in pair))
    rows = records.withColumn("fingerprint", mark(F.col(column)))
    return rows.withColumn("layout", F.try_element_at(names, F.col("fingerprint")))


def canonical(records: DataFrame, layouts: Iterable[Layout] = LAYOUTS, column: str = "record") -> DataFrame:
    """The turns of all records of a known layout."""
    layouts = tuple(layouts)
    rows = with_layout(records.select(column), layouts, column).withColumn("_v", F.try_parse_json(column)).where("layout is not null and _v is not null")
    turns, ids, rowwise = F.lit(None).cast(TURNS), F.lit(None).cast("long"), []
    for x in reversed(layouts):
        mine = F.col("layout") == x.name
        turns = F.when(mine, x.turns.turns(F.col("_v")).cast(TURNS)).otherwise(turns)
        names = ("conv_id",) if isinstance(x.turns, Row) else x.ids
        ids = F.when(mine, F.coalesce(*(F.try_variant_get(F.col("_v"), f"$.{p}", "long") for p in names))).otherwise(ids)
        rowwise += [x.name] * isinstance(x.turns, Row)
    rows = rows.select(ids.alias("conv_id"), F.when(F.col("layout").isin(rowwise), F.lit(0)).otherwise(F.monotonically_increasing_id() + 1).alias("part"), turns.alias("_t"))
    return rows.select("conv_id", "part", F.inline("_t"))


def rejected(records: DataFrame, layouts: Iterable[Layout] = LAYOUTS, column: str = "record") -> DataFrame:
    """Records that ``canonical`` leaves out: the record, its fingerprint and why."""
    rows = with_layout(records.select(column), layouts, column)
    bad = F.when(F.col("fingerprint").isNull() | F.try_parse_json(column).isNull(), F.lit("no JSON object")).when(F.col("layout").isNull(), F.lit("no layout has these fields"))
    return rows.withColumn("reason", bad).where("reason is not null").select(column, "fingerprint", "reason")


# ---- template -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Template:
    """Marks of turns, and all strings that must not occur in what turns say."""

    begin: str = "<|im_start|>"
    end: str = "<|im_end|>\n"
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    learned: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        for a, b in itertools.product(self.controls, repeat=2):
            if len(a) < 2 or "\\" in a or "\n" in a:
                raise ValueError(f"{a!r} cannot be a control string")
            if any(a[i:].startswith(b) or b.startswith(a[i:]) for i in range(1, len(a))):
                raise ValueError(f"control strings {a!r} and {b!r} can overlap")
        for mark in (self.begin, self.end):
            if not any(c in mark for c in self.controls):
                raise ValueError(f"{mark!r} holds no control string")

    def _after_first(self, between: str) -> str:
        """A pattern for the place after the first sign of every control string, for Java and Python alike."""
        firsts = dict.fromkeys(c[0] for c in self.controls)
        rest = {f: "|".join(re.escape(c[1:]).replace("/", r"\/") for c in self.controls if c[0] == f) for f in firsts}
        return "|".join(rf"(?<={re.escape(f)}){between}(?=\\*(?:{r}))" for f, r in rest.items())

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._after_first(""), r"\\")

    def unescape(self, text: str) -> str:
        return re.sub(self._after_first(r"\\"), "", text)

    def escape_role(self, role: Column) -> Column:
        return self.escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))

    def unescape_role(self, role: str) -> str:
        return re.sub(r"\\(.)", lambda x: "\n" if x[1] == "n" else x[1], self.unescape(role))

    def parse(self, piece: str) -> tuple[str, str]:
        """Role and text of a piece."""
        if not (piece.startswith(self.begin) and piece.endswith(self.end)):
            raise ValueError("a piece does not stand between the template's marks")
        role, _, text = piece[len(self.begin) : len(piece) - len(self.end)].partition("\n")
        return self.unescape_role(role), self.unescape(text)


TEMPLATE = Template()


def render(turns: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """A piece for each turn, with the code points [loss_start, loss_end) of it that are learned (null: none)."""
    rows = turns.withColumn("_head", F.concat(F.lit(template.begin), template.escape_role(F.coalesce("role", F.lit(""))), F.lit("\n")))
    rows = rows.withColumn("_body", template.escape(F.coalesce("text", F.lit(""))))
    learned, start = F.col("role").isin(list(template.learned)), F.length("_head").cast("long")
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("part").cast("long").alias("part"), F.col("turn").cast("long").alias("turn"), F.col("pos").cast("int").alias("pos"),
        F.concat("_head", "_body", F.lit(template.end)).alias("piece"), F.when(learned, start).alias("loss_start"), F.when(learned, start + F.length("_body")).alias("loss_end"),
    )


READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, part long"


def read_back(pieces: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Conversations from their pieces: parsed, unescaped and digested in order, one at a time."""
    names = [x.split()[0] for x in READ_BACK.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in READ_BACK.split(", ")])

    def out(done):
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in done], schema.field(n).type) for n in names], schema=schema)

    def digest(batches):
        key, now, turns, loss = None, None, None, None
        for b in batches:
            done = []
            for conv, part, piece, lo, hi in zip(*(b.column(c).to_pylist() for c in ("conv_id", "part", "piece", "loss_start", "loss_end"))):
                if now is None or (conv, part) != key:
                    if now is not None:
                        done.append(now | {"turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest()})
                    key, turns, loss = (conv, part), hashlib.sha256(), hashlib.sha256()
                    now = {"conv_id": conv, "part": part, "n_turns": 0, "loss_chars": 0, "formatted_chars": 0}
                role, text = template.parse(piece)
                turns.update(f"{role}\n{text}\n".encode())
                now["n_turns"] += 1
                now["formatted_chars"] += len(piece)
                if lo is not None:
                    learned = template.unescape(piece[lo:hi])
                    loss.update(learned.encode())
                    now["loss_chars"] += len(learned)
            yield out(done)
        if now is not None:
            yield out([now | {"turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest()}])

    rows = pieces.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "turn", "pos", "piece")
    return rows.select("conv_id", "part", "piece", "loss_start", "loss_end").mapInArrow(digest, READ_BACK)


def as_records(rows: DataFrame) -> DataFrame:
    """Rows of a table as JSON records; fields that are null stay in them."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))


def format_records(records: DataFrame, layouts: Iterable[Layout] = LAYOUTS, template: Template = TEMPLATE) -> DataFrame:
    """Convert, format, write to the shared folder; the written pieces."""
    scratch.bound_batches(records.sparkSession)
    return scratch.keep(render(canonical(records, layouts), template), "chat")
