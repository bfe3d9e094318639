"""Chat formatting by schema fingerprints: heterogeneous records to canonical turns to templated text with a loss mask.

A record is a VARIANT.  Its layout is the set of its nested field paths, as ``messages[].role`` (scalar types don't
count).  A declarative mapping says which paths it requires, which it can use beside them, and where turns lie; it takes
records of whose paths those that it uses have one of its fingerprints, and in which no string lies anywhere else but
below the names in ``IGNORED``.  Listed texts may be lists of parts of type text, which are joined.  The first mapping that
takes a record wins.  A record that none takes has null turns and no mapping (:func:`unmapped` lists them); as rows it is
one turn of role ``record`` that says the record as JSON.  So every string of a record is in some turn, but what
``IGNORED`` names.

The template writes a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside texts a backslash is written twice and
control strings get a backslash after their first character, so none of them survives in a text; dropping each
backslash before the next character restores the text.  Roles are URL-encoded.

Null texts and roles are empty.  Turns are ordered by turn number, place in the record, role and text; repeated rows
are repeated turns.  Rows with a null conversation id form one conversation.  A conversation, however long its texts, is
one row.  Other columns of the input don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# The marks of the template, and the control strings that no text may hold.
START, END = "<|im_start|>", "<|im_end|>\n"
_CONTROL = r"(\\|<(?=\||/?s>)|\[(?=/?INST\])|<(?=</?SYS>>))"

_TURNS = "array<struct<role:string,text:string>>"

#: Names, at any depth, of what describes a record and is said by nobody in it.
IGNORED = ("id", "conversation_id", "conv_id", "source", "dataset", "lang", "language", "tags", "split", "created_at", "updated_at", "meta", "metadata")
#: A part of a text that is listed, and the paths that it has.
_PARTS, _PART_PATHS = "array<struct<type:string,text:string>>", ("type", "text")


@dataclass(frozen=True)
class Mapping:
    """Where turns lie in records that have the paths ``required``, and maybe some of ``optional``.

    ``fields``: (role, field, ...) for each turn, texts of several fields joined by a blank line, absent ones skipped.
    ``list_of``: (array field, role field, text field, renamed roles) for layouts that list their turns.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    fields: tuple[tuple[str, ...], ...] = ()
    list_of: tuple[str, str, str, tuple[tuple[str, str], ...]] | None = None

    @property
    def parts(self) -> tuple[str, ...]:
        """The paths of listed texts that are lists of parts."""
        return tuple(f"{self.list_of[0]}[].{self.list_of[2]}[].{p}" for p in _PART_PATHS) if self.list_of else ()

    def takes(self, record: Column, paths: Column, strings: Column) -> Column:
        """Whether the paths that this mapping uses have one of its fingerprints, no other path leads to a string, and all
        parts of listed texts are text."""
        uses = F.array(*map(F.lit, (*self.required, *self.optional, *self.parts)))
        some = [c for n in range(len(self.optional) + 1) for c in combinations(self.optional, n)]
        known = [fingerprint(F.array(*map(F.lit, (*self.required, *c, *more)))) for c in some for more in {(), self.parts}]
        lost = F.filter(strings, lambda p: ~F.array_contains(uses, p) & ~F.arrays_overlap(F.split(F.regexp_replace(p, r"\[\]", ""), r"\."), F.array(*map(F.lit, IGNORED))))
        fits = fingerprint(F.array_intersect(paths, uses)).isin(*known) & (F.size(lost) == 0)
        return fits & F.coalesce(F.forall(self._items(record), lambda x: x["text"].isNotNull()), F.lit(False)) if self.list_of else fits

    def _items(self, record: Column) -> Column:
        """The listed turns; absent roles and texts are empty, and a text with other parts than text is null."""
        array, role, text, _ = self.list_of

        def said(x: Column) -> Column:
            listed = F.coalesce(F.schema_of_variant(F.try_variant_get(x, f"$.{text}", "variant")), F.lit("")).startswith("ARRAY")
            parts = F.try_variant_get(x, f"$.{text}", _PARTS)
            joined = F.when(F.forall(parts, lambda p: p["type"] == "text"), F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), ""))
            return F.when(listed, joined).otherwise(F.coalesce(F.try_variant_get(x, f"$.{text}", "string"), F.lit("")))

        return F.transform(F.try_variant_get(record, f"$.{array}", "array<variant>"), lambda x: F.struct(F.coalesce(F.try_variant_get(x, f"$.{role}", "string"), F.lit("")).alias("role"), said(x).alias("text")))

    def turns(self, record: Column) -> Column:
        if self.list_of:

            def turn(x: Column) -> Column:
                r = x["role"]
                for old, new in self.list_of[3]:
                    r = F.when(r == old, F.lit(new)).otherwise(r)
                return F.struct(r.alias("role"), x["text"].alias("text"))

            return F.transform(self._items(record), turn)
        get = lambda f: F.try_variant_get(record, f"$.{f}", "string")
        turn_of = lambda role, fields: F.struct(
            (F.coalesce(get(role[1:]), F.lit("")) if role.startswith("$") else F.lit(role)).alias("role"),
            F.coalesce(get(fields[0]), F.lit("")).alias("text") if len(fields) == 1 else F.concat_ws("\n\n", *(F.nullif(get(f), F.lit("")) for f in fields)).alias("text"),
        )
        return F.array(*(turn_of(role, fields) for role, *fields in self.fields)).cast(_TURNS)


# The layouts that are read.
MAPPINGS: tuple[Mapping, ...] = (
    Mapping("messages", ("messages", "messages[].role", "messages[].content"), list_of=("messages", "role", "content", ())),
    Mapping("from and value", ("conversations", "conversations[].from", "conversations[].value"), list_of=("conversations", "from", "value", (("human", "user"), ("gpt", "assistant")))),
    Mapping("instruction", ("instruction", "output"), ("input",), (("user", "instruction", "input"), ("assistant", "output"))),
    Mapping("prompt, system", ("prompt", "response", "system"), (), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt", ("prompt", "response"), (), (("user", "prompt"), ("assistant", "response"))),
    Mapping("completion", ("completion", "prompt"), (), (("user", "prompt"), ("assistant", "completion"))),
    Mapping("question", ("answer", "question"), (), (("user", "question"), ("assistant", "answer"))),
    Mapping("turn row", ("role", "text"), (), (("$role", "text"),)),
)

#: What matters in the text of a record's schema: brackets, field names, strings, and elements of several kinds.
_TOKENS = r"(OBJECT<|ARRAY<|>|`(?:[^`]|``)*`: |[^<>,:` ]+: |STRING|VARIANT)"


def _walk(record: Column) -> Column:
    """struct<paths, strings>: all nested field paths of a VARIANT, and those that lead to strings (or to values of several
    kinds, with {} at their end, since strings may be among these)."""
    tokens = F.regexp_extract_all(F.schema_of_variant(record), F.lit(_TOKENS), F.lit(1))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("above"), F.lit("").alias("here"), none.alias("paths"), none.alias("strings"))

    def step(a: Column, t: Column) -> Column:
        name = F.concat(F.coalesce(F.element_at(a["above"], -1), F.lit("")), F.regexp_replace(t, "^`|`?: $", ""))
        closed, opened, leaf = t == ">", t.isin("OBJECT<", "ARRAY<"), t.isin("STRING", "VARIANT")
        prefix = F.when((t == "OBJECT<") & (a["here"] != ""), F.concat(a["here"], F.lit("."))).otherwise(a["here"])
        above = F.when(closed, F.slice(a["above"], F.lit(1), F.greatest(F.size(a["above"]) - 1, F.lit(0)))).when(opened, F.concat(a["above"], F.array(prefix))).otherwise(a["above"])
        here = F.when(t == "ARRAY<", F.concat(a["here"], F.lit("[]"))).when(closed | opened | leaf, a["here"]).otherwise(name)
        paths = F.when(closed | opened | leaf, a["paths"]).otherwise(F.concat(a["paths"], F.array(name)))
        strings = F.when(leaf, F.concat(a["strings"], F.array(F.concat(a["here"], F.when(t == "VARIANT", "{}").otherwise(""))))).otherwise(a["strings"])
        return F.struct(above.alias("above"), here.alias("here"), paths.alias("paths"), strings.alias("strings"))

    sort = lambda c: F.array_sort(F.array_distinct(c))
    return F.aggregate(tokens, start, step, lambda a: F.struct(sort(a["paths"]).alias("paths"), sort(a["strings"]).alias("strings")))


def field_paths(record: Column) -> Column:
    """The nested field paths of a VARIANT, sorted, as ['messages', 'messages[].content', 'messages[].role']."""
    return _walk(record)["paths"]


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(F.array_sort(paths), "\n"))


def canonical_turns(records: DataFrame, record_col: str = "record", mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """``records`` with ``schema_fingerprint`` (of all field paths), ``mapping`` and ``turns`` array<struct<role,text>>; the
    last two are null where no mapping takes the layout."""
    paths, strings = (F.coalesce(F.col("__walk")[k], F.array().cast("array<string>")) for k in ("paths", "strings"))
    turns, name = F.lit(None).cast(_TURNS), F.lit(None).cast("string")
    for m in reversed(mappings):
        turns, name = F.when(F.col("mapping") == m.name, m.turns(F.col(record_col))).otherwise(turns), F.when(m.takes(F.col(record_col), paths, strings), m.name).otherwise(name)
    known = records.withColumn("__walk", _walk(F.col(record_col)))
    return known.withColumn("schema_fingerprint", fingerprint(paths)).withColumn("mapping", name).withColumn("turns", turns).drop("__walk")


def unmapped(records: DataFrame, record_col: str = "record", mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """The records whose layout no mapping takes, with ``schema_fingerprint``."""
    return canonical_turns(records, record_col, mappings).where(F.col("mapping").isNull()).drop("mapping", "turns")


def turn_rows(records: DataFrame, record_col: str = "record", conv_col: str = "conv_id", turn_col: str = "turn", mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """(conv_id, turn, place, role, text): the turns of all records, those of unknown layout as JSON."""
    whole = F.array(F.struct(F.lit("record").alias("role"), F.coalesce(F.to_json(F.col(record_col)), F.lit("")).alias("text")))
    turns = canonical_turns(records, record_col, mappings)
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.posexplode(F.coalesce("turns", whole)).alias("place", "said"))
    return rows.select("conv_id", "turn", "place", "said.role", "said.text")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(turns: DataFrame, conv_col: str = "conv_id", order_cols: Sequence[str] = ("turn", "place")) -> DataFrame:
    """(conv_id, formatted, loss_mask array<struct<start,length>>) of (conv_id, order..., role, text) rows.

    The mask covers, in code points from 0, the written text of each assistant turn and nothing else."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(START), F.url_encode(role), F.lit("\n"))
    rows = turns.select(F.col(conv_col).alias("conv_id"), *order_cols, role.alias("role"), text.alias("text"), head.alias("head"), escape(text).alias("body"))
    key = [*order_cols, "role", "text"]
    before = W.partitionBy("conv_id").orderBy(*key).rowsBetween(W.unboundedPreceding, W.currentRow)
    size = F.char_length("head") + F.char_length("body") + len(END)
    rows = rows.withColumn("to", F.sum(size.cast("long")).over(before))
    item = F.struct(*order_cols, F.col("to"), F.col("role"), F.concat("head", "body", F.lit(END)).alias("piece"), F.char_length("body").cast("long").alias("length"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    spoken = F.filter("items", lambda x: x["role"] == "assistant")
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("items", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(spoken, lambda x: F.struct((x["to"] - len(END) - x["length"]).alias("start"), x["length"].alias("length"))).alias("loss_mask"),
    )


def read_rows(rendered: DataFrame) -> DataFrame:
    """(conv_id, place, size, role, text, loss): the turns read back from formatted text, and what the loss mask covers of
    each (null: nothing).  A mask is met at the place where its turn's text begins."""
    pieces = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda p: p != "")
    rows = rendered.select("conv_id", F.posexplode(pieces).alias("place", "piece"))
    before = W.partitionBy("conv_id").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("cut", F.instr("piece", "\n")).withColumn("size", (F.char_length("piece") + len(END)).cast("long"))
    rows = rows.withColumn("at", F.sum("size").over(before) - F.col("size") + F.col("cut"))
    mask = rendered.select(F.col("conv_id").alias("__conv"), F.explode("loss_mask").alias("m")).select("__conv", F.col("m.start").alias("__start"), F.col("m.length").alias("__length"))
    met = rows.join(mask.hint("merge"), F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("at") == F.col("__start")), "left")
    cut, body = F.col("cut"), F.col("piece").substr(F.col("cut") + 1, F.char_length("piece"))
    role = F.url_decode(F.col("piece").substr(F.lit(len(START) + 1), cut - len(START) - 1))
    return met.select("conv_id", "place", "size", role.alias("role"), unescape(body).alias("text"), unescape(body.substr(F.lit(1), F.col("__length").cast("int"))).alias("loss"))


def digests(rendered: DataFrame) -> DataFrame:
    """Counts and hashes of what formatted conversations say, read back from them."""
    items = F.array_sort(F.collect_list(F.struct("place", "role", "text", "loss")))
    grouped = read_rows(rendered).groupBy("conv_id").agg(items.alias("items"), F.sum("size").alias("formatted_chars"))
    said = F.array_join(F.transform("items", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("items", lambda t: t["loss"]), "")
    return grouped.select("conv_id", "items", said.alias("said"), loss.alias("loss"), "formatted_chars").select(
        "conv_id",
        F.size("items").cast("long").alias("n_turns"),
        F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
