"""Chat records of differing layouts to canonical turns, formatted text and a loss mask.

A record's layout is known by its schema fingerprint: the hash of the sorted paths of the
fields that it fills. The fingerprint selects a declarative mapping; nothing is guessed from
values. Turns are then written with a template whose control strings cannot occur inside
texts: there they get a backslash after their first character, and lose it when read back.

Defined results: a null text or role is empty; a record of unknown layout has layout null and
no turns; unknown fields are ignored, whatever their names; ties in `turn` go by role, then
text; repeated rows stay repeated; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

# Template and control strings: fixed values. A text that holds one of them, or one with
# backslashes after its first character, gets one backslash more there.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
CONTROL = r"(\||/?s>|</?SYS>>|/?INST\])"
OPENING = r"([<\[])"
ESCAPED = re.compile(OPENING + r"\\(\\*)" + CONTROL)
PIECE = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*)<\|end\|>\n", re.DOTALL)

# Every field that some layout uses.
RECORD = (
    "system string, prompt string, response string, instruction string, input string, output string, "
    "question string, answer string, role string, text string, "
    "messages array<struct<role string, content string>>, "
    "conversations array<struct<`from` string, value string>>"
)
# Spark's JSON reader gives up strings above 20 million characters unless told otherwise.
WHOLE = {"maxStringLen": str(2**31 - 1)}
# Speakers of the layout that names them differently: fixed values.
SPEAKERS = {"human": "user", "user": "user", "gpt": "assistant", "assistant": "assistant", "system": "system"}


@dataclass(frozen=True)
class Layout:
    """Paths a record must and may fill, and its turns: (role, SQL text) pairs or one SQL array."""

    name: str
    needs: tuple[str, ...]
    may: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] | str


_SPEAKER = "CASE lower(m.`from`) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SPEAKERS.items()) + " ELSE m.`from` END"
_SYSTEM = ("system", "r.system")
LAYOUTS = (
    Layout("prompt", ("prompt", "response"), ("system",), (_SYSTEM, ("user", "r.prompt"), ("assistant", "r.response"))),
    Layout(
        "instruction",
        ("instruction", "output"),
        ("input", "system"),
        (
            _SYSTEM,
            ("user", "concat(r.instruction, if(coalesce(r.input, '') = '', '', concat('\\n\\n', r.input)))"),
            ("assistant", "r.output"),
        ),
    ),
    Layout("question", ("question", "answer"), ("system",), (_SYSTEM, ("user", "r.question"), ("assistant", "r.answer"))),
    Layout(
        "messages",
        ("messages[].role",),
        ("messages[].content",),
        "transform(r.messages, m -> named_struct('role', coalesce(m.role, ''), 'text', coalesce(m.content, '')))",
    ),
    Layout(
        "conversations",
        ("conversations[].from",),
        ("conversations[].value",),
        f"transform(r.conversations, m -> named_struct('role', coalesce({_SPEAKER}, ''), 'text', coalesce(m.value, '')))",
    ),
    Layout("turn", ("role",), ("text",), "array(named_struct('role', r.role, 'text', coalesce(r.text, '')))"),
    Layout("text", ("text",), (), "array(named_struct('role', '', 'text', r.text))"),
    Layout("blank turn", (), (), "array(named_struct('role', '', 'text', ''))"),
)


def fingerprint(paths) -> str:
    """Schema fingerprint of a set of field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def fingerprints() -> dict[str, Layout]:
    """Every fingerprint of every layout: with each choice of the fields it may fill."""
    out: dict[str, Layout] = {}
    for layout in LAYOUTS:
        for k in range(len(layout.may) + 1):
            for more in combinations(layout.may, k):
                out.setdefault(fingerprint((*layout.needs, *more)), layout)
    return out


def _paths(record: str) -> Column:
    """SQL array of the paths that a record of type RECORD fills, sorted."""
    def filled(path: str) -> str:
        if "[]." in path:
            outer, inner = path.split("[].")
            return f"exists({record}.{outer}, m -> m.`{inner}` IS NOT NULL)"
        return f"{record}.{path} IS NOT NULL"

    every = sorted({p for layout in LAYOUTS for p in (*layout.needs, *layout.may)})
    return F.expr("array_compact(array(" + ", ".join(f"CASE WHEN {filled(p)} THEN '{p}' END" for p in every) + "))")


def _of_type(value: Column, kind: DataType, wanted: DataType) -> Column:
    """The value as the wanted part of RECORD: strings as they are, anything else as its JSON reads."""
    if kind == wanted or kind.typeName() in ("char", "varchar", "void"):
        return value.cast(wanted)
    if wanted.typeName() == "array" and kind.typeName() == "array" and kind.elementType.typeName() == "struct":
        return F.transform(value, lambda m: _filled(m, kind.elementType, wanted.elementType))
    read = F.from_json(F.to_json(F.struct(value.alias("v"))), f"v {wanted.simpleString()}", WHOLE)
    return read["v"]


def _filled(record: Column, kind: StructType, wanted: StructType) -> Column:
    """The struct with the wanted fields, null where it has none of the name."""
    return F.struct(*[
        (_of_type(record[f.name], kind[f.name].dataType, f.dataType) if f.name in kind.names else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in wanted.fields
    ])


def _record(record: str, kind: StructType) -> Column:
    """A struct column as one of type RECORD."""
    return _filled(F.col(record), kind, StructType.fromDDL(RECORD))


def canonical_turns(df: DataFrame, record: str) -> DataFrame:
    """Turns of the records in the JSON string or struct column `record`.

    Adds `fingerprint`, `layout` and `turns` (array of role and text), replacing columns so
    named. Fields that no layout uses are left out before the fingerprint is taken. Of a
    struct, a record that fills nothing is a blank turn; of a JSON string, it has no layout.
    """
    kind = df.schema[record].dataType
    fields = _record(record, kind) if kind.typeName() == "struct" else F.from_json(record, RECORD, WHOLE)
    df = df.withColumn("__r", fields)
    df = df.withColumn("fingerprint", F.sha2(F.array_join(_paths("__r"), "\n"), 256))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role string, text string>>")
    codes: dict[str, list[str]] = {}
    for code, chosen in fingerprints().items():
        codes.setdefault(chosen.name, []).append(code)
    for chosen in LAYOUTS:
        if chosen.needs or kind.typeName() == "struct":
            own = F.col("fingerprint").isin(codes[chosen.name])
            layout = F.when(own, F.lit(chosen.name)).otherwise(layout)
            turns = F.when(own, F.expr(_turns_sql(chosen))).otherwise(turns)
    return df.withColumn("layout", layout).withColumn("turns", turns).drop("__r")


def _turns_sql(layout: Layout) -> str:
    """The turns of a layout as SQL over the struct column `__r`."""
    if isinstance(layout.turns, str):
        sql = layout.turns
    else:
        parts = [f"CASE WHEN {t} IS NOT NULL THEN named_struct('role', '{role}', 'text', {t}) END" for role, t in layout.turns]
        sql = "array_compact(array(" + ", ".join(parts) + "))"
    return re.sub(r"\br\.", "__r.", sql)


def escaped(text: Column) -> Column:
    """The text with one more backslash inside every control string."""
    return F.regexp_replace(text, OPENING + r"(\\*)" + CONTROL, r"$1\\$2$3")


def unescaped(text: str) -> str:
    """What `escaped` was given."""
    return ESCAPED.sub(r"\1\2\3", text)


def formatted(df: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """Add `piece`, the formatted turn, and its loss mask: `loss_start` and `loss_chars` in code
    points of the piece, zero long unless the assistant speaks. Pieces in turn order, joined
    with nothing between, are the formatted conversation."""
    role_text, said = escaped(F.coalesce(role, F.lit(""))), escaped(F.coalesce(text, F.lit("")))
    begin = F.concat(F.lit(TURN), role_text, F.lit(TEXT))
    speaks = F.coalesce(F.col(role) == "assistant", F.lit(False))
    return (
        df.withColumn("__begin", begin)
        .withColumn("__said", said)
        .withColumn("piece", F.concat("__begin", "__said", F.lit(END)))
        .withColumn("loss_start", F.length("__begin").cast("long"))
        .withColumn("loss_chars", F.when(speaks, F.length("__said")).otherwise(0).cast("long"))
        .drop("__begin", "__said")
    )


def digests(df: DataFrame, conversation: str = "conv_id", order: tuple[str, ...] = ("turn", "role", "text")) -> DataFrame:
    """Read formatted turns back, one row per conversation.

    Needs the columns of `formatted`. Rows are dealt by conversation and sorted; each task
    then reads its rows as a stream and holds one turn at a time, so a conversation of any
    length takes no memory. A digest over a conversation's text is sequential by definition,
    so the rows of one conversation meet in one task.
    """
    picked = df.select(conversation, *order, "piece", "loss_start", "loss_chars")
    ranked = picked.repartition(conversation).sortWithinPartitions(conversation, *order)
    schema = (
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now, state = None, None

        def close() -> None:
            if state is not None:
                turns, all_said, loss, loss_said, chars = state
                done.append((now, turns, all_said.hexdigest(), loss, loss_said.hexdigest(), chars))

        def flush() -> pa.RecordBatch:
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = [pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in (conversation, "piece", "loss_start", "loss_chars"))
            for key, piece, start, size in zip(*columns, strict=True):
                if state is None or key != now:
                    close()
                    now, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, said = (unescaped(x) for x in PIECE.fullmatch(piece).groups())
                lost = unescaped(piece[start : start + size])
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
                state[2] += len(lost)
                state[3].update(lost.encode())
                state[4] += len(piece)
            if len(done) >= 1000:
                yield flush()
        close()
        yield flush()

    return ranked.select(F.col(conversation).cast("long").alias(conversation), "piece", "loss_start", "loss_chars").mapInArrow(run, schema)
