"""Secret scan with corpus-wide ownership of what looks like a credential.

Every text is scanned whole for three kinds of spans (see ``KINDS``) and for bare tokens that
look random. The values of all spans are hashed, and hashes are aggregated over the corpus by
distinct repositories and distinct owners. A value that at least ``min_copied`` owners hold in as
many repositories is a copied example; any other that may be a credential is live-looking, however
often its owners repeat it. An assigned value may be one by its place, others by looking random.
Bare tokens whose value is a live-looking credential somewhere in the corpus are added as spans of
kind ``owned``.

Only hashes and offsets of spans are shuffled, with partial aggregates, so a value in a third of
all rows is one row per task. Nothing is broadcast.

Cases. A null text is empty. Offsets are code points, ends exclusive. Rows that repeat are
reported each, and do not add owners. A null owner is an unknown owner of its own repository, or of
its own text if that is null too. Dots at the end of a value belong to the sentence, not to the
credential: they take no part in its hash. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sevfold.llm import textkernel as K
from sevfold.llm.tables import BROADCAST_BYTES, set_down, small_batches

KINDS = ("assign", "access", "hex", "owned")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: A text without any of these has no span of kind assign.
HINTS = ("passw", "secret", "token", "api")
#: Long words mark a placeholder anywhere, as chance does not make them; what chance makes, as a whole word.
#: A run of such words is read in one way only, so that long runs of a digit take no more than one pass.
PLACEHOLDER = re.compile(
    r"example|sample|changeme|placeholder|dummy|(?<![a-z0-9])(?:your[a-z]*|(?:x{3,}+|0{6,}+|0?+123456(?:7(?:8(?:9(?:0(?!0{5}))?+)?+)?+)?+|abcdef(?:gh)?+)++)(?![a-z0-9])|^(.)\1*$", re.I
)
RANDOM_LENGTH = 16
ASSIGN_LENGTH = 8
MIN_COPIED = 3
MASK = "[secret]"
HIDE = "__hide"
#: Bytes of a span in a broadcast, with its share of the row.
SPAN_BYTES = 100

_HEX = K._table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x66)
_TOKEN = K._table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b in b"+/_.=-")
SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.int32()), ("h", pa.int64()), ("strong", pa.bool_())])
SPANS = "array<struct<kind:int,start:int,end:int,value:int,h:bigint,strong:boolean>>"


def value_hash(value: str) -> int:
    """Hash of a value without dots at its end."""
    return int.from_bytes(hashlib.blake2b(value.rstrip(".").encode(), digest_size=8).digest(), "little", signed=True)


def looks_random(value: str) -> bool:
    """Long, varied and not a placeholder."""
    return len(value) >= RANDOM_LENGTH and len(set(value)) >= 8 and _mixed(value) and not PLACEHOLDER.search(value)


def _mixed(value: str) -> bool:
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def _span(kind: int, start: int, end: int, at: int, value: str) -> dict:
    strong = looks_random(value) if kind else len(value.rstrip(".")) >= ASSIGN_LENGTH and not PLACEHOLDER.search(value)
    return {"kind": kind, "start": start, "end": end, "value": at, "h": value_hash(value), "strong": strong}


def bare_tokens(run: str) -> list[tuple[int, int]]:
    """Parts of a run of value characters that may be a value: all, what follows ``=``, what stands between marks."""
    marks = [m.span() for m in re.finditer(r"[^=.]+=*", run)] + [m.span() for m in re.finditer(r"[^=]+=*", run)] + [m.span() for m in re.finditer(r"[^.]+", run)]
    first = run.find("=") + 1
    parts = {(a, a + len(run[a:b].rstrip("."))) for a, b in [(0, len(run)), (first, len(run)), *marks]}
    return sorted(p for p in parts if p[1] - p[0] >= ASSIGN_LENGTH and _mixed(run[p[0] : p[1]]))


def base_spans(text: str, may_hex: bool = True) -> list[dict]:
    """Spans of the three base kinds in a whole text."""
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [_span(0, m.start(), m.end(), m.start(2), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        found += [_span(1, m.start(), m.end(), m.start(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if may_hex:
        found += [_span(2, m.start(), m.end(), m.start(), m[0]) for m in HEX.finditer(text)]
    return found


def _long_runs(piece: K.Piece, table: np.ndarray, least: int) -> dict[int, list[tuple[int, int]]]:
    """Runs of at least ``least`` bytes of ``table`` by row, as byte offsets in the row."""
    starts, ends, _ = K.word_ranges(piece, table)
    long = np.flatnonzero(ends - starts >= least)
    rows = np.searchsorted(piece.offsets, starts[long], side="right") - 1
    out: dict[int, list[tuple[int, int]]] = {}
    for r, s, e in zip(rows.tolist(), starts[long].tolist(), ends[long].tolist()):
        out.setdefault(r, []).append((s - int(piece.offsets[r]), e - int(piece.offsets[r])))
    return out


def _scanner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for piece in K.pieces(texts):
            hexes, tokens = _long_runs(piece, _HEX, 32), _long_runs(piece, _TOKEN, ASSIGN_LENGTH)
            base, bare, own = [], [], []
            for i, text in enumerate(texts[piece.lo : piece.hi].to_pylist()):
                text = text or ""
                spans = base_spans(text, i in hexes)
                base.append(spans)
                bare.append([])
                own.append(value_hash(text) if spans else None)
                if i in tokens:
                    raw = text.encode()
                    taken = {(s["value"], s["h"]) for s in spans}
                    done = chars = 0
                    for a, b in tokens[i]:
                        token = raw[a:b].decode()
                        chars, done = chars + len(raw[done:a].decode()), a
                        found = [_span(3, chars + p, chars + q, chars + p, token[p:q]) for p, q in bare_tokens(token)]
                        bare[-1] += [s for s in found if (s["value"], s["h"]) not in taken]
            rest = [batch.column(c)[piece.lo : piece.hi] for c in ("doc_id", "repo", "owner")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(base, pa.list_(SPAN)), pa.array(bare, pa.list_(SPAN)), pa.array(own, pa.int64())], names=["doc_id", "repo", "owner", "base", "bare", "own"])


def scan(docs: DataFrame, repo: str, owner: str) -> DataFrame:
    """Spans of each row, set down with a number for each row (``rid``)."""
    small_batches(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(repo).cast("string").alias("repo"), F.col(owner).cast("string").alias("owner"), "text")
    rows = read.mapInArrow(_scanner, f"doc_id long, repo string, owner string, base {SPANS}, bare {SPANS}, own long")
    return set_down(rows.withColumn("rid", F.monotonically_increasing_id()), "spans")


def ownership(scanned: DataFrame) -> DataFrame:
    """``h, n_repos, n_owners, strong`` for each hash of a base span."""
    owner = F.coalesce(F.concat(F.lit("o"), "owner"), F.concat(F.lit("r"), "repo"), F.concat(F.lit("t"), F.col("own").cast("string")))
    repo = F.coalesce(F.concat(F.lit("r"), "repo"), F.concat(F.lit("t"), F.col("own").cast("string")))
    values = scanned.select(repo.alias("repo"), owner.alias("owner"), F.explode("base").alias("s")).select("repo", "owner", "s.h", "s.strong")
    each = values.groupBy("h", "owner", "repo").agg(F.max("strong").alias("strong"))
    repos = each.groupBy("h", "repo").agg(F.max("strong").alias("strong")).groupBy("h").agg(F.count("*").alias("n_repos"), F.max("strong").alias("strong"))
    owners = each.groupBy("h", "owner").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("*").alias("n_owners"))
    return repos.join(owners, "h").select("h", "n_repos", "n_owners", "strong")


def classified(scanned: DataFrame, min_copied: int) -> DataFrame:
    """Spans of each row with any: ``rid, doc_id, spans`` with what the corpus says of each.

    ``copied`` marks spans whose value at least ``min_copied`` owners hold in as many repositories,
    ``live`` all others that may be a credential: no class is between.
    """
    known = set_down(ownership(scanned), "owners")
    copied = (F.col("n_owners") >= min_copied) & (F.col("n_repos") >= min_copied)
    live = ~copied & F.col("strong")
    marks = known.select("h", live.alias("live"), copied.alias("copied"))
    base = scanned.select("rid", "doc_id", F.explode("base").alias("s"))
    bare = scanned.select("rid", "doc_id", F.explode("bare").alias("s"))
    spans = base.unionAll(bare).select("rid", "doc_id", "s", F.col("s.h").alias("h")).join(marks, "h").filter("live or s.kind < 3")
    one = F.struct("s.start", "s.kind", "s.end", "s.value", "h", "live", "copied")
    return spans.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(one)).alias("spans"))


def _written(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, repo: str, owner: str, min_copied: int = MIN_COPIED) -> DataFrame:
    """``doc_id``, counts of base spans by kind, digest of them, all spans, counts of live-looking and copied ones."""
    scanned = scan(docs, repo, owner)
    found = classified(scanned, min_copied).select("rid", "spans")
    rows = scanned.select("rid", "doc_id").join(found, "rid", "left").withColumn("spans", F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)))
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    kind = lambda k: lambda s: s["kind"] == k  # noqa: E731 - a second parameter, even with a default, would be the place of the span
    return rows.select(
        "doc_id",
        *[count(kind(k)).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(_written(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: s["copied"]).alias("n_copied"),
    )


def _masker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, lengths = batch.column("text").to_pylist(), batch.column("n_chars").to_pylist()
        for i, spans in enumerate(batch.column(HIDE).to_pylist()):
            if not spans or texts[i] is None:
                continue
            old, out, done = texts[i], [], 0
            for s in sorted(spans, key=lambda s: (s["value"], -s["end"])):
                if s["value"] >= done and value_hash(old[s["value"] : s["end"]]) == s["h"]:
                    out += [old[done : s["value"]], MASK]
                    done = s["end"]
            if done:
                texts[i] = "".join(out) + old[done:]
                lengths[i] = len(texts[i])
        names = [c for c in batch.schema.names if c != HIDE]
        new = {"text": pa.array(texts, batch.schema.field("text").type), "n_chars": pa.array(lengths, pa.int64())}
        yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names=names)


def mask_live(docs: DataFrame, repo: str, owner: str) -> DataFrame:
    """Documents with the values of live-looking spans replaced by ``MASK``; ``n_chars`` follows.

    Spans are joined to texts by the hash of the text, not by ids, so rows with a null or a repeated id are masked each by its own.
    """
    keyed = docs.select(F.xxhash64("text").alias("doc_id"), "text", F.col(repo).alias("__repo"), F.col(owner).alias("__owner"))
    spans = classified(scan(keyed, "__repo", "__owner"), MIN_COPIED).withColumn("hide", F.filter("spans", lambda s: s["live"])).filter("size(hide) > 0")
    hide = set_down(spans.groupBy(F.col("doc_id").alias("__text")).agg(F.max("hide").alias(HIDE)), "hide")
    spans_in_all = hide.agg(F.sum(F.size(HIDE))).first()[0] or 0
    fits = spans_in_all * SPAN_BYTES <= BROADCAST_BYTES
    found = docs.withColumn("n_chars", F.col("n_chars").cast("long")).join(F.broadcast(hide) if fits else hide, F.xxhash64(docs["text"]) == F.col("__text"), "left")
    read = found.select(*["`{}`".format(c.replace("`", "``")) for c in docs.columns], HIDE)
    schema = ", ".join("`{}` {}".format(f.name.replace("`", "``"), f.dataType.simpleString()) for f in read.schema if f.name != HIDE)
    return read.mapInArrow(_masker, schema)
