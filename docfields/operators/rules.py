"""Deterministic, executor-side field extraction with native regex rules.

All rules use the subset of regex syntax that Java (Spark) and RE2 read the
same way: no look-around, no ``\\b``, ``[^\\n]`` instead of ``.``, explicit
character classes instead of ``(?i)``.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.functions.text import strip_text


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    group: int = 0
    # literal(s) every match contains: the regex runs only on texts that have
    # one (a fast substring scan skips the backtracking engine elsewhere)
    hints: tuple[str, ...] = ()
    # the same matches for backtracking engines (Java in Spark, Python's re):
    # a left-boundary look-behind so a long run of the leading class is tried
    # from its start only (linear instead of quadratic); RE2 (the SQL oracle)
    # is linear already and has no look-behind, so it keeps ``pattern``
    backtracking_pattern: str | None = None
    backtracking_group: int | None = None

    @property
    def jvm_pattern(self) -> str:
        return self.backtracking_pattern or self.pattern

    @property
    def jvm_group(self) -> int:
        return self.group if self.backtracking_group is None else self.backtracking_group


def _guarded(text: Column, rule: Rule, expr: Column, empty: Column) -> Column:
    if not rule.hints:
        return expr
    cond = None
    for h in rule.hints:
        c = F.instr(text, h) > 0
        cond = c if cond is None else cond | c
    return F.when(cond, expr).otherwise(empty)


# One number of an IPv4 address, 0 to 255.
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

# Rule registry: name -> pattern (group 0 = whole match).
RULES: dict[str, Rule] = {r.name: r for r in [
    Rule("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}", 0, ("@",),
         r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"),
    # bounded on both sides: no part of a longer number or dotted run
    Rule("ip", rf"(?:^|[^0-9.])((?:{OCTET}[.]){{3}}{OCTET})(?:$|[^0-9.]|[.](?:$|[^0-9]))", 1, (".",),
         rf"(?<![0-9.])(?:{OCTET}[.]){{3}}{OCTET}(?![0-9]|[.][0-9])", 0),
    Rule("card", r"(?:^|[^0-9])([0-9]{16})(?:$|[^0-9])", 1, (), r"(?<![0-9])[0-9]{16}(?![0-9])", 0),
    Rule("phone", r"[+][0-9] [(][0-9]{3}[)] [0-9]{3}-[0-9]{4}", 0, ("+",)),
    Rule("token", r'token = "([0-9A-Za-z_-]+)"', 1, ('token = "',)),
    # anchored at a line start (start of text or after a newline) so the
    # backtracking engine scans each line once instead of once per position
    Rule("license", r"(?:^|\n)([^\n]*[Ll]icen[sc]e[^\n]*)", 1, ("icense", "icence")),
]}

# Requested-field spellings mapped to rule names.
ALIASES = {
    "email": "email", "emails": "email", "email address": "email", "e-mail": "email",
    "ip": "ip", "ip address": "ip", "ipv4": "ip",
    "card": "card", "card number": "card", "credit card": "card",
    "phone": "phone", "phone number": "phone", "telephone": "phone",
    "token": "token", "api token": "token", "secret": "token",
    "license": "license", "licence": "license", "license line": "license",
}


def resolve_field(field: str) -> str | None:
    """Requested field text -> rule name (None when no rule knows it)."""
    key = " ".join(field.strip().lower().replace("_", " ").split())
    return ALIASES.get(key, key if key in RULES else None)


def extract_rules(docs: DataFrame, fields: list[str], key_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Long result: one row per (document, requested field).

    Columns: key, ``ordinal`` (1-based request order), ``field`` (as requested),
    ``value`` (first match or null), ``n_matches`` and ``confidence`` (1.0 when
    found by a rule, null otherwise). A field without a rule is a not-found
    row; :func:`extract_fields` also looks for labels and sections and gives all
    matches. Runs as one projection + generator: no shuffle, no Python.
    """
    text = F.col(text_col)
    items = []
    for i, f in enumerate(fields):
        rule = RULES.get(resolve_field(f) or "")
        if rule is None:
            matches = F.array().cast("array<string>")
        else:
            matches = _guarded(text, rule, F.regexp_extract_all(text, F.lit(rule.jvm_pattern), rule.jvm_group),
                               F.array().cast("array<string>"))
        items.append(F.struct(F.lit(i + 1).alias("ordinal"), F.lit(f).alias("field"),
                              matches.alias("_m")))
    out = docs.select(F.col(key_col), F.inline(F.array(*items)))
    n = F.coalesce(F.size("_m"), F.lit(0)).cast("bigint")
    return out.select(key_col, "ordinal", "field",
                      F.try_element_at("_m", F.lit(1)).alias("value"),
                      F.when(n > 0, n).otherwise(F.lit(0)).alias("n_matches"),
                      F.when(n > 0, F.lit(1.0)).alias("confidence"))


def label_pattern(label: str) -> str:
    """``^<label>:[ \\t]*(value)$`` on any line (multi-line mode)."""
    esc = "".join("\\" + ch if ch in string.punctuation else ch for ch in label)
    return rf"(?m)^{esc}:[ \t]*([^\n]*)$"


def extract_key_values(docs: DataFrame, labels: dict[str, str], key_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """``Label: value`` lines -> one column per requested label (null when absent).

    ``labels`` maps output column -> label text as printed in the document.
    """
    cols = []
    for out_name, label in labels.items():
        v = F.regexp_extract(F.col(text_col), label_pattern(label), 1)
        cols.append(F.when(v != "", strip_text(v)).alias(out_name))
    return docs.select(F.col(key_col), *cols)


# Clause vocabulary: clause name -> line pattern.
CLAUSES = {
    "license": r"[Ll]icen[sc]e",
    "parties": r"[Pp]art(y|ies)|[Bb]etween",
    "effective_date": r"[Ee]ffective",
    "payment": r"[Pp]ayment|[Pp]ayable",
    "termination": r"[Tt]erminat",
    "renewal": r"[Rr]enew",
}


def extract_clauses(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text",
                    clauses: dict[str, str] | None = None) -> DataFrame:
    """Lines that match a clause vocabulary -> ``(key, line_no, clause, line)``.

    Lines are numbered from 1. The vocabulary is a fixed list of patterns
    evaluated per line (no join against a clause table); non-matches are
    dropped by a plain filter after the explode (stays in codegen, unlike a
    lambda over the array).
    """
    vocab = clauses or CLAUSES
    lines = docs.select(F.col(key_col), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("_pos", "line"))
    hits = F.array(*[F.when(F.col("line").rlike(p), F.lit(name)) for name, p in vocab.items()])
    return (lines.select(key_col, (F.col("_pos") + 1).cast("bigint").alias("line_no"), "line",
                         F.explode(hits).alias("clause"))
                 .where(F.col("clause").isNotNull())
                 .select(key_col, "line_no", "clause", "line"))


# a heading or label: a capital, then words of any length with the usual marks
HEADING_PATTERN = r"[A-Z][A-Za-z0-9 &/'(),.#-]*"


# headings without a colon: a line in capitals, or a title of up to six words
# between an empty line (or the start) and a line with text
CAPITALS_PATTERN = r"[A-Z][A-Z0-9 &/'(),.-]*[A-Z0-9 &/'()-]{2}"
TITLE_PATTERN = r"[A-Z][A-Za-z]*(?: [A-Za-z&/'()-]+){0,5}"


def with_sections(docs: DataFrame, text_col: str, heading: str = HEADING_PATTERN, bare: bool = False) -> DataFrame:
    """``docs`` with ``_lines`` (the text's lines) and ``_sections``: an array of
    ``heading, body`` in text order, the first without a heading if the text
    does not begin with one.

    The text is read line by line: a line is a heading or not by its own
    pattern and its two neighbours, and the lines from one heading to the next
    are its body. Cost is linear in the text, whatever the length of a section;
    no pattern ever spans lines. ``bare`` counts headings without a colon too.
    The line break before a heading, and one at the end of the text, belong to
    no body.
    """
    blank = lambda line: F.coalesce(strip_text(line) == "", F.lit(True))

    def is_heading(line: Column, i: Column) -> Column:
        marked = line.rlike(rf"^{heading}:\r?\z")
        if not bare:
            return marked
        alone = ((i == 0) | blank(F.get("_lines", i - 1))) & ~blank(F.get("_lines", i + 1))
        return marked | line.rlike(rf"^{CAPITALS_PATTERN}\r?\z") | (line.rlike(rf"^{TITLE_PATTERN}\r?\z") & alone)

    def section(k: Column, begin: Column, end: Column) -> Column:
        body = F.array_join(F.slice("_lines", begin + 1, end - begin), "\n")
        last = end == F.size("_lines")
        title = F.regexp_replace(strip_text(F.get("_lines", k)), ":$", "")
        return F.struct(F.when(k >= 0, title).alias("heading"),
                        F.when(last, F.regexp_replace(body, r"\n\z", "")).otherwise(body).alias("body"))

    # each step reads the one before as a column, so that no work is repeated
    lined = docs.withColumn("_lines", F.split(F.col(text_col), "\n", -1))
    places = F.filter(F.transform("_lines", lambda x, i: F.when(is_heading(x, i), i)), lambda i: i.isNotNull())
    placed = lined.withColumn("_at", places)
    first = F.when(F.coalesce(F.get("_at", F.lit(0)) > 0, F.size("_at") == 0),
                   F.array(section(F.lit(-1), F.lit(0), F.coalesce(F.get("_at", F.lit(0)), F.size("_lines")))))
    rest = F.transform("_at", lambda k, i: section(k, k + 1, F.coalesce(F.get("_at", i + 1), F.size("_lines"))))
    empty = F.array().cast("array<struct<heading:string,body:string>>")
    return placed.withColumn("_sections", F.concat(F.coalesce(first, empty), F.coalesce(rest, empty))).drop("_at")


def extract_sections(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text",
                     heading: str = HEADING_PATTERN, bare: bool = False) -> DataFrame:
    """Heading lines (``<Heading>:``) split a text into sections.

    ``(key, section_no, heading, body)``, sections numbered from 1 in text
    order; text before the first heading is a section with a null heading. With
    ``bare``, lines in capitals and titles on a line of their own are headings
    too. Each document is read inside its own row (no shuffle), line by line.
    """
    read = with_sections(docs.select(F.col(key_col), F.col(text_col)), text_col, heading, bare)
    there = F.when(F.col("_lines").isNotNull(), F.col("_sections"))
    return (read.select(F.col(key_col), F.posexplode(there).alias("_pos", "_s"))
                .select(key_col, (F.col("_pos") + 1).cast("bigint").alias("section_no"), "_s.heading", "_s.body"))


FORM_QUOTED = r'([A-Za-z_][A-Za-z0-9_]*) = "([^"\n]*)"'
FORM_COLON = rf"(?m)^({HEADING_PATTERN}):[ \t]*([^\n]+)$"


def extract_form_fields(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key = "value"`` and ``Key: value`` pairs -> ``(key, form, name, value)``."""
    quoted, colon = FORM_QUOTED, FORM_COLON
    t = F.col(text_col)

    def pairs(pattern: str, form: str) -> Column:
        return F.zip_with(F.regexp_extract_all(t, F.lit(pattern), 1), F.regexp_extract_all(t, F.lit(pattern), 2),
                          lambda n, v: F.struct(F.lit(form).alias("form"), n.alias("name"), v.alias("value")))
    both = F.concat(pairs(quoted, "assign"), pairs(colon, "label"))
    return docs.select(F.col(key_col), F.inline(both))


def extract_table_cells(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text",
                        delimiter: str = "|") -> DataFrame:
    """Delimited lines -> ``(key, line_no, col_no, cell)``, 1-based, cells stripped."""
    lines = docs.select(F.col(key_col), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("_lp", "_line"))
    rows = lines.where(F.instr(F.col("_line"), delimiter) > 0)
    cells = rows.select(key_col, (F.col("_lp") + 1).cast("bigint").alias("line_no"),
                        F.posexplode(F.split(F.col("_line"), f"[{delimiter}]", -1)).alias("_cp", "_cell"))
    return cells.select(key_col, "line_no", (F.col("_cp") + 1).cast("bigint").alias("col_no"),
                        strip_text(F.col("_cell")).alias("cell"))


# a line between header and body, of dashes and colons; a cell that is a number
RULE_LINE = r"^[ \t:+=-]*-[ \t:+=-]*\z"
NUMBER_CELL = r"^[+-]?[$€£]?[0-9][0-9.,]*%?\z"


def extract_tables(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", delimiter: str = "|") -> DataFrame:
    """Delimited lines restructured into tables and records: ``key, table_no,
    row_no, col_no, header, value``, all numbers from 1.

    Lines with the delimiter that follow each other are a table, if there are
    two or more; any other line ends it. Cells are stripped; an empty cell
    before a leading or after a trailing delimiter is none. Lines of dashes are
    no rows. The first row is the header if others follow and none of its cells
    is empty or a number; otherwise columns are ``col_1, col_2, ...``, as are
    cells beyond the header. A row shorter than the header has null values for
    the rest. Tables are found inside each document's row by where their lines
    begin and end: no shuffle, and linear in the text.
    """
    lined = docs.select(F.col(key_col), F.split(F.col(text_col), "\n", -1).alias("_lines"))
    flagged = F.transform("_lines", lambda x: F.instr(x, delimiter) > 0)
    placed = lined.withColumn("_in", flagged)

    def edges(neighbour: int) -> Column:
        here = F.transform("_in", lambda there, i: F.when(there & ~F.coalesce(F.get("_in", i + neighbour), F.lit(False)), i))
        return F.filter(here, lambda i: i.isNotNull())

    spans = F.filter(F.arrays_zip(edges(-1).alias("a"), edges(1).alias("b")), lambda s: s["b"] > s["a"])
    tables = placed.select(key_col, "_lines", F.posexplode(spans).alias("_t", "_s"))
    inner = lambda line: F.regexp_replace(strip_text(line), f"^[{delimiter}]|[{delimiter}]\\z", "")
    cells = F.transform(F.slice("_lines", F.col("_s.a") + 1, F.col("_s.b") - F.col("_s.a") + 1), lambda line: F.transform(
        F.split(inner(line), f"[{delimiter}]", -1), strip_text))
    rows = F.filter(cells, lambda row: ~F.array_join(row, "").rlike(RULE_LINE))
    cut = tables.select(key_col, "_t", rows.alias("_rows"))
    first = F.get("_rows", F.lit(0))
    named = cut.withColumn("_head", F.when((F.size("_rows") > 1) & ~F.exists(first, lambda c: (c == "") | c.rlike(NUMBER_CELL)), first))
    body = F.when(F.col("_head").isNull(), F.col("_rows")).otherwise(F.slice("_rows", 2, F.size("_rows")))
    records = named.select(key_col, "_t", "_head", F.posexplode(body).alias("_r", "_cells"))
    width = F.greatest(F.size("_cells"), F.coalesce(F.size("_head"), F.lit(0)))
    values = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.struct(
        F.coalesce(F.get("_head", i), F.concat(F.lit("col_"), (i + 1).cast("string"))).alias("header"), F.get("_cells", i).alias("value")))
    return (records.select(key_col, "_t", "_r", F.posexplode(values).alias("_c", "_v"))
                   .select(key_col, *[(F.col(f"_{k[0]}") + 1).cast("bigint").alias(f"{k}_no") for k in ("table", "row", "col")],
                           "_v.header", "_v.value"))


def rule_column(field: str, text: Column) -> Column:
    """First match of the rule for ``field`` (null when absent or unknown)."""
    rule = RULES.get(resolve_field(field) or "")
    if rule is None:
        return F.lit(None).cast("string")
    v = F.regexp_extract(text, rule.jvm_pattern, rule.jvm_group)
    return _guarded(text, rule, F.when(v != "", v), F.lit(None).cast("string"))


# words that an item of an instruction has around its name
BEFORE_NAME = {"key", "full", "contract", "professional", "work", "main", "overall", "each", "all", "the"}
AFTER_NAME = {"involved", "conditions", "terms", "information", "details", "list", "included"}


def field_names(item: str) -> tuple[str, list[str]]:
    """The name that an item of an instruction asks for, and further names.

    Remarks in brackets are left out. Further names are the parts around "and"
    and "of", and each without the words that stand around a name: ``Key skills
    (list all)`` is ``key skills``, then ``skills``; ``Payment terms and
    schedule`` is that, then ``payment terms``, ``schedule`` and ``payment``.
    """
    name = " ".join(re.sub(r"\([^)]*\)?", " ", item).replace("_", " ").split())
    parts = [p for p in re.split(r"(?i) (?:and|of|&) |,", name) if p.strip()]
    names = [name, *parts]
    for part in [name, *parts]:
        words = part.split()
        while len(words) > 1 and words[0].lower() in BEFORE_NAME:
            words = words[1:]
            names.append(" ".join(words))
        while len(words) > 1 and words[-1].lower() in AFTER_NAME:
            words = words[:-1]
            names.append(" ".join(words))
    names = list(dict.fromkeys(" ".join(n.lower().split()) for n in names if n.strip()))
    return (names[0], names[1:]) if names else ("", [])


def extract_fields(docs: DataFrame, fields: list[str], key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Requested fields by rule, else by label, else by section, else by clause;
    one row per (document, field): ``ordinal, field, value`` (first match),
    ``matches`` (all), ``n_matches``, ``found_by`` (rule, label, section,
    clause, or null).

    A label is the field's name at a line start before a colon, in any case; a
    section is the text under a heading of that name (with a colon, in capitals
    or as a title of its own) up to the next heading. An item with qualifiers
    goes by its further names (:func:`field_names`) where its own is not found;
    a clause is a line that speaks of what the item names (``CLAUSES``). Native
    projections and a generator: no shuffle, no Python, linear in the text.
    """
    text, none = F.col("_text"), F.array().cast("array<string>")
    read = with_sections(docs.select(F.col(key_col), F.col(text_col).alias("_text")), "_text", bare=True)
    # headings as they are compared: in lower case, white space as one space
    read = read.withColumn("_named", F.transform("_sections", lambda s: F.struct(
        F.lower(F.regexp_replace(s["heading"], "[ _\t]+", " ")).alias("name"), strip_text(s["body"]).alias("body"))))

    def by_label(names: list[str]) -> Column:
        words = "|".join("[ _]+".join(re.escape(w) for w in n.split()) for n in names)
        return F.regexp_extract_all(text, F.lit(rf"(?im)^(?:{words})[ \t]*:[ \t]*([^\s][^\n]*)$"), 1)

    def by_section(names: list[str]) -> Column:
        there = F.filter("_named", lambda s: s["name"].isin(names) & (s["body"] != ""))
        return F.transform(there, lambda s: s["body"])

    def lines_with(pattern: str) -> Column:
        return F.filter("_lines", lambda line: line.rlike(pattern))

    items = []
    for i, f in enumerate(fields):
        rule = RULES.get(resolve_field(f) or "")
        name, others = field_names(f)
        found = [] if rule is None else [(_guarded(
            text, rule, F.regexp_extract_all(text, F.lit(rule.jvm_pattern), rule.jvm_group), none), "rule")]
        for names in ([name], others):
            if any(names):
                found += [(by_label(names), "label"), (by_section(names), "section")]
        clauses = [p for p in CLAUSES.values() if re.search(p, name)]
        if clauses:
            spoken = "|".join(f"(?:{p})" for p in clauses)
            found.append((lines_with(spoken), "clause"))
        items.append(F.struct(F.lit(i + 1).alias("ordinal"), F.lit(f).alias("field"),
                              F.coalesce(*[F.when(F.size(m) > 0, F.transform(m, strip_text)) for m, _ in found], none).alias("matches"),
                              F.coalesce(*[F.when(F.size(m) > 0, F.lit(n)) for m, n in found],
                                         F.lit(None).cast("string")).alias("found_by")))
    out = read.select(F.col(key_col), F.inline(F.array(*items)))
    return out.select(key_col, "ordinal", "field", F.try_element_at("matches", F.lit(1)).alias("value"), "matches",
                      F.size("matches").cast("bigint").alias("n_matches"), "found_by")
