"""Source code as text: comments, lines and line scopes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters that end a line of text besides the pair CR LF.
LINE_ENDS = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
LINE_BREAK = rf"\r\n|[{LINE_ENDS}]"
FILE_SEPARATOR = r"##<END>##[\r\n]"

EMPTY_INTS = "cast(array() as array<int>)"
EMPTY_STRINGS = "cast(array() as array<string>)"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clean_code(c: Column) -> Column:
    """Drop comments, blank lines, tabs and leading blanks, in this order."""
    no_line_comments = F.regexp_replace(c, r"//[^\n]*\n", "")
    no_comments = F.regexp_replace(no_line_comments, r"(?s)/\*.*?\*/", "")
    no_blank_lines = F.regexp_replace(no_comments, r"(?mdU)^\s*$", "")
    no_tabs = F.translate(no_blank_lines, "\t", "")
    return F.regexp_replace(no_tabs, r"(?mdU)^\s+", "")


def clean_changes(c: Column) -> Column:
    """Drop the marker line between the files of one change."""
    return F.regexp_replace(c, FILE_SEPARATOR, "")


def split_lines(c: Column) -> Column:
    """Lines of a text; a line break at the very end opens no further line."""
    body = F.regexp_replace(c, rf"(?:{LINE_BREAK})\z", "")
    return F.when(F.length(c) == 0, F.expr(EMPTY_STRINGS)).otherwise(F.split(body, LINE_BREAK))


def strip_line_comment(line: Column) -> Column:
    """Cut at ``//``; in a line without it, cut the first ``/*`` to ``*/``."""
    slashes = F.instr(line, "//")
    opened, closed = F.instr(line, "/*"), F.instr(line, "*/")
    block_cut = F.concat(
        F.substring(line, F.lit(1), opened - 1),
        F.substring(line, closed + 2, F.length(line)),
    )
    return (
        F.when(slashes > 0, F.substring(line, F.lit(1), slashes - 1))
        .when((opened > 0) & (closed > 0), block_cut)
        .otherwise(line)
    )


def filter_lines(lines: Column) -> Column:
    """Strip comments line by line and join the lines again."""
    return F.array_join(F.transform(lines, strip_line_comment), "\n")


def parse_lines(c: Column) -> Column:
    """``"3 7 9"`` as an array of ints; a missing list is an empty one."""
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    return F.coalesce(F.transform(words, lambda w: w.cast("int")), F.expr(EMPTY_INTS))


# A column that a lambda refers to is evaluated again for each element, so what is used
# inside one is bound with ``let`` first.


def existing(lines: Column, numbers: Column) -> Column:
    """Line numbers that the function has; numbers count from 1."""
    return let(F.size(lines), lambda n: F.filter(numbers, lambda i: (i >= 1) & (i <= n)))


def pick(lines: Column, numbers: Column) -> Column:
    """Lines of the given numbers, in their order; numbers without a line are passed over."""
    return let(lines, lambda a: F.transform(existing(a, numbers), lambda i: F.get(a, i - 1)))


def slice_all(lines: Column) -> Column:
    return filter_lines(lines)


def slice_vuln(lines: Column, vul: Column) -> Column:
    """Only the vulnerable lines, in the order they are listed."""
    return filter_lines(pick(lines, vul))


def slice_context(lines: Column, vul: Column) -> Column:
    """Every line but the vulnerable ones."""
    return filter_lines(let(vul, lambda v: F.filter(lines, lambda _, i: ~F.array_contains(v, i + 1))))


def scope_lines(lines: Column, vul: Column, k: int) -> Column:
    """Numbers of the vulnerable lines and of the ``k`` lines on both sides."""

    def around(n: Column) -> Column:
        inside = F.filter(vul, lambda i: (i >= 1) & (i <= n))
        return F.transform(inside, lambda i: F.sequence(F.greatest(i - k, F.lit(1)), F.least(i + k, n)))

    return F.sort_array(F.array_distinct(F.flatten(let(F.size(lines), around))))


def slice_surrounding(lines: Column, vul: Column, k: int = 6) -> Column:
    return let(lines, lambda a: filter_lines(pick(a, scope_lines(a, vul, k))))


def slice_surrounding_only(lines: Column, vul: Column, k: int = 6) -> Column:
    return let(lines, lambda a: filter_lines(pick(a, F.array_except(scope_lines(a, vul, k), vul))))


def random_lines(lines: Column, vul: Column, key: Column, seed: int = 42) -> Column:
    """As many other lines as there are vulnerable ones, drawn by a hash of key and line."""

    def drawn(n: Column, v: Column) -> Column:
        numbers = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.expr(EMPTY_INTS))
        others = F.filter(numbers, lambda i: ~F.array_contains(v, i))
        hashed = F.transform(
            others,
            lambda i: F.struct(
                F.md5(F.concat_ws("|", key.cast("string"), i.cast("string"), F.lit(str(seed)))).alias("h"), i.alias("line")
            ),
        )
        wanted = F.size(F.filter(v, lambda i: (i >= 1) & (i <= n)))
        return F.transform(F.slice(F.sort_array(hashed), F.lit(1), wanted), lambda s: s["line"])

    return let(F.size(lines), lambda n: let(vul, lambda v: drawn(n, v)))


def slice_random(lines: Column, vul: Column, key: Column, seed: int = 42) -> Column:
    return let(lines, lambda a: filter_lines(pick(a, random_lines(a, vul, key, seed))))
