"""Text functions whose white space, digits and words are Unicode's, on the JVM side.

Java's ``\\s`` is ASCII unless ``(?U)`` is given, its ``\\v`` is a class and its
``.`` and ``$`` know more line ends than a newline; the patterns here say what
they mean. ``trim`` removes U+0020 only, hence ``strip``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space: Unicode's, and the four separators that count as such beside it. Fixed values.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """White space off both ends."""
    return F.btrim(col(c), F.lit(SPACES))


def blank(c: Column | str) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(~col(c).rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(True))


def empty(c: Column | str) -> Column:
    """True for null and empty text; white space counts as text."""
    return F.coalesce(col(c) == "", F.lit(True))


def squeeze(c: Column | str) -> Column:
    """Runs of spaces become one."""
    return F.regexp_replace(col(c), " {2,}", " ")


def stem(name: Column | str) -> Column:
    """A file name without its last suffix; a leading dot starts no suffix."""
    return F.regexp_replace(col(name), r"(?s)(?<=.)\.[^.]+\z", "")


def suffix(name: Column | str) -> Column:
    """The last suffix with its dot, lower-cased, or ''."""
    return F.lower(F.regexp_extract(col(name), r"(?s).(\.[^.]+)\z", 1))


def lines(c: Column | str) -> Column:
    return F.split(col(c), "\n", -1)


def join_lines(parts: Column) -> Column:
    return F.array_join(parts, "\n")


def first_of(c: Column, *others: Column | str) -> Column:
    """``c`` unless it is null or empty, then the next."""
    return F.coalesce(*[F.nullif(x if isinstance(x, Column) else F.lit(x), F.lit("")) for x in (c, *others[:-1])], others[-1] if isinstance(others[-1], Column) else F.lit(others[-1]))


def fill(template: Column | str, values: dict[str, Column | str]) -> Column:
    """Named placeholders ``{name}`` replaced in one pass: what a value brings in is never read as a placeholder.

    ``{{`` and ``}}`` stand for braces. A plain string is taken apart when the
    plan is built, a column in the plan.
    """
    if isinstance(template, Column):
        marks = {name: f"\x02{name}\x03" for name in values}
        marked = reduce(lambda t, n: F.replace(t, F.lit("{" + n + "}"), F.lit(marks[n])), values, template)
        parts = F.split(marked, "\x02|\x03", -1)
        known = F.create_map(*[x for n, v in values.items() for x in (F.lit(n), F.coalesce(_lit(v), F.lit("")))])
        return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, known[p]).otherwise(_unbrace(p))), "")
    pieces: list[Column] = []
    rest = template
    while rest:
        at = [(rest.index("{" + n + "}"), n) for n in values if "{" + n + "}" in rest]
        if not at:
            pieces.append(F.lit(_plain(rest)))
            break
        i, name = min(at)
        pieces += [F.lit(_plain(rest[:i])), F.coalesce(_lit(values[name]), F.lit(""))]
        rest = rest[i + len(name) + 2 :]
    return F.concat(*pieces) if pieces else F.lit("")


def _lit(v: Column | str) -> Column:
    return v.cast("string") if isinstance(v, Column) else F.lit(v)


def _plain(text: str) -> str:
    return text.replace("{{", "{").replace("}}", "}")


def _unbrace(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))


def collect_joined(value: str, order: str, separator: str) -> Column:
    """Ordered string aggregation; null values are left out."""
    return F.expr(f"listagg({value}, '{separator}') WITHIN GROUP (ORDER BY {order})")
