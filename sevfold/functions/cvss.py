"""CVE ids, CVSS vectors and severity labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Ordinal codes of the labels.
SEVERITY = {"LOW": 0, "MEDIUM": 1, "HIGH": 2, "CRITICAL": 3}
CVSS3_CODES = {
    "AV": {"N": 0, "A": 1, "L": 2, "P": 3},
    "AC": {"L": 0, "H": 1},
    "PR": {"N": 0, "L": 1, "H": 2},
    "UI": {"N": 0, "R": 1},
    "S": {"U": 0, "C": 1},
    "C": {"N": 0, "L": 1, "H": 2},
    "I": {"N": 0, "L": 1, "H": 2},
    "A": {"N": 0, "L": 1, "H": 2},
}
LEVELS = ("LOW", "MEDIUM", "HIGH")
IMPACT = ("NONE", "PARTIAL", "COMPLETE")
CVSS2_SCALES = {
    "cvss2_conf": IMPACT,
    "cvss2_integrity": IMPACT,
    "cvss2_avail": IMPACT,
    "cvss2_accessvect": None,
    "cvss2_accesscomp": LEVELS,
    "cvss2_auth": None,
    "cvss2_severity": LEVELS,
}


def encode(c: Column, mapping: dict[str, int]) -> Column:
    """Code of a label; a label outside the mapping stops the job, null stays null."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    code = F.try_element_at(table, c)
    unknown = F.raise_error(F.concat(F.lit("unknown label: "), c)).cast("int")
    return F.when(c.isNull(), F.lit(None).cast("int")).otherwise(F.coalesce(code, unknown))


def severity_code(c: Column) -> Column:
    return encode(c, SEVERITY)


def pick_cvss(texts: Column) -> Column:
    """First text that is a CVSS-3 vector."""
    return F.try_element_at(F.filter(texts, lambda t: t.startswith("CVSS:3")), F.lit(1))


def parse_cvss(vector: Column) -> Column:
    """Metrics of a CVSS-3 vector as a map from metric to value."""
    return F.str_to_map(F.regexp_replace(vector, r"^CVSS:3[^/]*/", ""), F.lit("/"), F.lit(":"))


def cvss_codes(metrics: Column) -> dict[str, Column]:
    """Codes of the eight base metrics, one column each."""
    return {m: encode(F.try_element_at(metrics, F.lit(m)), codes) for m, codes in CVSS3_CODES.items()}


def cve_year(c: Column) -> Column:
    year = F.regexp_extract(c, r"CVE-(\d{4})-", 1)
    return F.when(year != "", year.cast("int"))


def partial_score(a: Column, b: Column, scale: tuple[str, ...]) -> Column:
    """Half a point per step between two labels of a three-step scale; ``-`` costs nothing.

    A label outside the scale gives null.
    """
    steps = F.array(*[F.lit(s) for s in scale])
    pos_a, pos_b = F.array_position(steps, a), F.array_position(steps, b)
    distance = F.when((pos_a > 0) & (pos_b > 0), F.abs(pos_a - pos_b) / 2.0)
    return F.when(a == b, 0.0).when((a == "-") | (b == "-"), 0.0).otherwise(distance)
