"""Chat formatting by a finite-state machine over roles, in DataFrame functions only.

A template names the control strings, how a turn is framed, which roles carry loss and
which role may follow which. Each conversation becomes a list of segments (text, loss);
their concatenation is the formatted text. Inside texts and roles the first character of
every control string is escaped, so control strings occur only where the template puts
them, and the escape is undone exactly when reading back.

Defined cases: a null text or role is empty; turns are taken by (turn, role, text), nulls
first, and repeated rows are turns of their own; rows with a null conv_id form one
conversation; an empty table gives no row; other columns are ignored. A conversation
whose turn order the machine refuses is formatted all the same, with valid = false.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    begin: str = "<s>"
    open_turn: str = "<|im_start|>"
    close_turn: str = "<|im_end|>\n"
    control: tuple[str, ...] = ("<s>", "</s>", "<|im_start|>", "<|im_end|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accept: tuple[str, ...] = ("assistant",)
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )

    def codes(self) -> list[tuple[str, str]]:
        """(character, escape code): the backslash first, then each opening character, and the line end that closes a role."""
        firsts = dict.fromkeys(c[0] for c in self.control)
        return [("\\", "\\b"), *((c, f"\\{chr(0x63 + k)}") for k, c in enumerate(firsts)), ("\n", "\\n")]


def escape(c: Column, template: Template, role: bool = False) -> Column:
    for char, code in template.codes():
        if char != "\n" or role:
            c = F.replace(c, F.lit(char), F.lit(code))
    return c


def unescape(c: Column, template: Template, role: bool = False) -> Column:
    for char, code in reversed(template.codes()):
        if char != "\n" or role:
            c = F.replace(c, F.lit(code), F.lit(char))
    return c


def format_chats(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, segments array<struct<text, loss>>, formatted, valid, state (where the machine stopped)."""
    t = template
    turn = F.struct(F.col("turn").alias("k"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn), _by_turn).alias("turns"))
    moves = F.create_map(*[F.lit(x) for (state, role), to in t.moves.items() for x in (f"{state}\n{role}", to)])
    state = F.aggregate("turns", F.lit(t.start), lambda s, x: F.coalesce(F.try_element_at(moves, F.concat(s, F.lit("\n"), x.role)), F.lit("refused")))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def turn_segments(x: Column) -> Column:
        return F.array(
            segment(F.concat(F.lit(t.open_turn), escape(x.role, t, role=True), F.lit("\n")), F.lit(False)),
            segment(escape(x.text, t), x.role.isin(*t.loss_roles)),
            segment(F.lit(t.close_turn), F.lit(False)),
        )

    begin = F.array(segment(F.lit(t.begin), F.lit(False)))
    out = chats.select("conv_id", F.concat(begin, F.flatten(F.transform("turns", turn_segments))).alias("segments"), state.alias("state"))
    text = F.concat_ws("", F.transform("segments", lambda s: s.text))
    return out.select("conv_id", "segments", text.alias("formatted"), F.col("state").isin(*t.accept).alias("valid"), "state")


def _by_turn(a: Column, b: Column) -> Column:
    def order(x: Column, y: Column) -> Column:
        return F.when(x.isNull() & y.isNull(), 0).when(x.isNull(), -1).when(y.isNull(), 1).when(x < y, -1).when(x > y, 1).otherwise(0)

    by_k, by_role = order(a.k, b.k), order(a.role, b.role)
    return F.when(by_k != 0, by_k).when(by_role != 0, by_role).otherwise(order(a.text, b.text))


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, turns array<struct<role, text>> parsed from `formatted`, loss_text from the flagged segments."""
    t = template
    body = F.substring(F.col("formatted"), len(t.begin) + 1, 2147483647)
    pieces = F.filter(F.split(body, _quoted(t.close_turn)), lambda x: x.startswith(t.open_turn))

    def turn(x: Column) -> Column:
        cut = F.call_function("instr", x, F.lit("\n"))
        role = F.call_function("substring", x, F.lit(len(t.open_turn) + 1), cut - len(t.open_turn) - 1)
        text = F.call_function("substring", x, cut + 1)
        return F.struct(unescape(role, t, role=True).alias("role"), unescape(text, t).alias("text"))

    loss = F.concat_ws("", F.transform(F.filter("segments", lambda s: s.loss), lambda s: unescape(s.text, t)))
    return formatted.select("conv_id", F.transform(pieces, turn).alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")


def _quoted(text: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in text)


def digests(back: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid."""
    said = F.concat_ws("", F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )
