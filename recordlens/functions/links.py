"""Link columns, cell references and HYPERLINK formulas."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from recordlens.functions.text import strip

# Stripped texts that stand for a missing link.
EMPTY_LINKS = ("0", "0.0", "0.0.0.0", "nan", "None")
# The same for raw spreadsheet cells.
EMPTY_CELL_LINKS = ("0", "0.0", "0.0.0.0")

# Fixed value: the grammar of a spreadsheet cell address.
CELL_REF = r"^\$?([A-Za-z]{1,3})\$?([0-9]+)$"


def clean_link(c: Column) -> Column:
    s = F.coalesce(strip(c), F.lit(""))
    return F.when(s.isin(*EMPTY_LINKS), F.lit("")).otherwise(s)


def choose_link(bug_url: Column, link: Column) -> Column:
    """A non-blank URL wins over the link column; placeholder values become empty."""
    chosen = F.coalesce(F.when(strip(bug_url) != "", bug_url), link, F.lit(""))
    return F.when(strip(chosen).isin(*EMPTY_LINKS), F.lit("")).otherwise(chosen)


def url_for_id(work_item_id: Column, base_url: str) -> Column:
    """``base_url`` followed by the id; NULL or blank ids give empty text."""
    return F.when(work_item_id != "", F.concat(F.lit(base_url), work_item_id)).otherwise("")


def column_index(letters: Column) -> Column:
    """Spreadsheet column letters to a 1-based number."""
    codes = F.filter(F.split(F.upper(letters), ""), lambda ch: ch != "")
    return F.aggregate(codes, F.lit(0), lambda acc, ch: acc * F.lit(26) + F.ascii(ch) - F.lit(64))


def reference_column(ref: Column) -> Column:
    """Column number of a cell reference such as ``$C$7``; NULL when it is none."""
    letters = F.regexp_extract(ref, CELL_REF, 1)
    return F.when(letters != "", column_index(letters))


def leading_column(ref: Column) -> Column:
    """Column number from the leading letters of a cell's own address."""
    return column_index(F.regexp_extract(ref, r"^([A-Za-z]*)", 1))


def hyperlink_argument(formula: Column) -> Column:
    """First argument of a HYPERLINK formula, empty for any other formula.

    It ends at the first comma or closing parenthesis that neither quotes nor parentheses, nested to any depth, hide.
    One pass over the characters keeps the depth, whether a quote is open, and the end once it is found.
    """
    call = F.regexp_extract(strip(formula), r"(?is)^=?\s*HYPERLINK\((.*)$", 1)
    start = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(-1).alias("end")
    )

    def step(s: Column, ch: Column) -> Column:
        plain = ~s["quoted"]
        ends = plain & (s["depth"] == 0) & ch.isin(",", ")")
        change = F.when(plain & (ch == "("), 1).when(plain & (ch == ")"), -1).otherwise(0)
        return F.when(s["end"] >= 0, s).otherwise(
            F.struct(
                (s["at"] + 1).alias("at"),
                (s["depth"] + change).alias("depth"),
                F.when(ch == '"', plain).otherwise(s["quoted"]).alias("quoted"),
                F.when(ends, s["at"]).otherwise(F.lit(-1)).alias("end"),
            )
        )

    def cut(s: Column) -> Column:
        return F.when(s["end"] >= 0, F.substring(call, F.lit(1), s["end"])).otherwise(call)

    return strip(F.aggregate(F.split(call, ""), start, step, cut))


def concat_tokens(expression: Column) -> Column:
    """Operands of an ``&`` concatenation; an ampersand inside quotes does not split."""
    tokens = F.regexp_extract_all(expression, F.lit(r'((?:"[^"]*+"|[^&"]++)++)'), F.lit(1))
    return F.filter(F.transform(tokens, strip), lambda t: t != "")


def is_literal(token: Column) -> Column:
    return token.startswith('"') & token.endswith('"') & (F.length(token) >= 2)


def literal_text(token: Column) -> Column:
    return token.substr(F.lit(2), F.length(token) - F.lit(2))


def complete_edit_url(url: Column, work_item_id: Column) -> Column:
    """A web address that ends in ``/edit`` gets the record id appended."""
    bare = F.regexp_replace(url, "/+$", "")
    wants_id = url.rlike("^https?://") & bare.endswith("/edit")
    return F.when(wants_id, F.concat(bare, F.lit("/"), work_item_id)).otherwise(url)


def shift_rows(template: Column, base_row: Column, row: Column) -> Column:
    """Point references to ``base_row`` inside a shared formula at ``row`` instead."""
    pattern = F.concat(F.lit(r"(?<cell>\$?[A-Za-z]{1,3}\$?)"), base_row.cast("string"), F.lit(r"\b"))
    return F.regexp_replace(template, pattern, F.concat(F.lit("${cell}"), row.cast("string")))
