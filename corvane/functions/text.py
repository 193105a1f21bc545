"""Column expressions for identifiers, tokens, labels, excerpts and the small rules on records. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import constants as C


def java_edges(pattern: str) -> str:
    r"""The pattern with ASCII word edges in place of \b."""
    head, tail = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
    if pattern.startswith(r"\b"):
        pattern = head + pattern[2:]
    return pattern[:-2] + tail if pattern.endswith(r"\b") else pattern


def normalise_facet(raw: Column) -> Column:
    """The identifier that raw names, or null."""
    f = F.lower(F.trim(raw))
    f = F.when(f.startswith(":"), F.substring(f, 2, 1 << 30)).otherwise(f)
    f = F.btrim(f, F.lit(C.FACET_TRIM))
    longest = F.array_max(F.transform(F.split(f, "[._-]"), lambda s: F.octet_length(s)))
    good = (F.octet_length(f) >= C.FACET_BYTES) & ~f.isin(C.FACET_NOISE) & ~f.rlike(r"^[0-9._-]*$") & (longest >= C.FACET_SEGMENT)
    return F.when(good, f)


def facets(body: Column, vocabulary: list[str] | None = None, most: int = C.FACETS_PER_RECORD) -> Column:
    """The identifiers a body names: distinct, in order, the first `most`."""
    found = F.flatten(F.array(*[F.regexp_extract_all(body, F.lit(java_edges(p)), F.lit(0)) for p in C.FACET_PATTERNS]))
    names = F.filter(F.transform(found, normalise_facet), lambda f: f.isNotNull() & ~f.isin(C.OWN_VOCABULARY if vocabulary is None else vocabulary))
    return F.slice(F.array_sort(F.array_distinct(names)), 1, most)


#: Letters with marks and the letters they are found by.
MARKED, PLAIN = "àâäáãåçèéêëìíîïñòóôöõùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased, Latin marks folded; folding keeps letters letters, so only runs that are not ASCII are folded."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(runs, lambda w: F.when(F.octet_length(w) == F.char_length(w), w).otherwise(F.translate(w, MARKED, PLAIN)))


def fields(text: Column) -> Column:
    """White-space separated fields of a draft."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def search_terms(body: Column) -> Column:
    """The longest words worth searching files for, in order."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(body), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) >= C.SEARCH_TERM_CHARS) & ~w.isin(C.SEARCH_STOPWORDS)))
    ranked = F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.array_sort(F.transform(F.slice(ranked, 1, C.SEARCH_TERMS), lambda x: x["w"]))


def excerpt(body: Column) -> Column:
    """The first line, cut at EXCERPT_BYTES bytes; a character cut in two is dropped."""
    line = F.split(F.btrim(body, F.lit(" \t\n\x0b\f\r")), "\n")[0]
    cut = F.decode(F.substring(F.encode(line, "UTF-8"), 1, C.EXCERPT_BYTES), "ISO-8859-1")
    whole = F.regexp_replace(cut, r"(?:[\xC0-\xFF]|[\xE0-\xFF][\x80-\xBF]|[\xF0-\xFF][\x80-\xBF]{2})$", "")
    return F.when(F.octet_length(line) > C.EXCERPT_BYTES, F.concat(F.rtrim(F.decode(F.encode(whole, "ISO-8859-1"), "UTF-8")), F.lit("…"))).otherwise(line)


def label_ids(line: Column, marker: str = C.MARKER) -> Column:
    """Ids labelled on a line; a line with the ignore mark has none."""
    found = F.regexp_extract_all(line, F.lit(rf"(?i){marker}[ \t]*:[ \t]*({C.LABEL_ID})"), F.lit(1))
    return F.when(line.rlike(rf"(?i){marker}[ \t]*:[ \t]*ignore"), F.array().cast("array<string>")).otherwise(F.transform(found, F.lower))


def file_kind(path: Column) -> Column:
    doc = "|".join(e[1:] for e in C.DOC_EXTENSIONS)
    return F.when(F.lower(path).rlike(rf"\.(?:{doc})$"), "doc").otherwise("code")


def searchable(status: Column) -> Column:
    return status.isin(C.SEARCHABLE)


def in_namespace(namespace: Column, ns: str | None) -> Column:
    """The namespace itself and what is below it; none means all."""
    return F.lit(True) if not ns else (namespace == ns) | namespace.startswith(ns + "/")


def modality_conflict(a: Column, b: Column) -> Column:
    known = a.isin(C.MODALITIES) & b.isin(C.MODALITIES)
    return F.coalesce(known & (a.isin(C.NEGATIVE) != b.isin(C.NEGATIVE)), F.lit(False))


def modality_sign(m: Column) -> Column:
    """-1 for what must not or should not be, 1 for the others, 0 where nothing is said; opposed ones have a negative product."""
    return F.when(m.isin(C.NEGATIVE), -1).when(m.isin(C.MODALITIES), 1).otherwise(0)


def grew(old: Column, new: Column) -> Column:
    """Whether an update adds so much that it may be two statements."""
    before, added = F.octet_length(old), F.octet_length(new) - F.octet_length(old)
    return (before > 0) & (added >= C.GROWTH_BYTES) & (added >= C.GROWTH_PART * before)


def rewrite_id(text: Column, old: Column, new: Column) -> Column:
    """old replaced by new where it stands as a whole id."""
    edge = "[A-Za-z0-9_/-]"
    return F.regexp_replace(text, F.concat(F.lit(rf"(?<!{edge})\Q"), old, F.lit(rf"\E(?!{edge})")), new)


def line_range_hash(text: Column, start: Column, end: Column) -> Column:
    """SHA-256 of lines start..end (from 1, both included); null when out of range."""
    lines = F.split(text, "\n")
    ok = (start >= 1) & (end >= start) & (end <= F.size(lines))
    return F.when(ok, F.sha2(F.array_join(F.slice(lines, start, end - start + 1), "\n"), 256))


def source_range(spec: Column) -> Column:
    """file, start, end of `file:10-14` or `file:10`; null where it is neither."""
    pattern = r"^(.+):(\d+)(?:-(\d+))?$"
    part = lambda i: F.regexp_extract(spec, pattern, i)
    start = part(2).try_cast("int")
    return F.when(spec.rlike(pattern), F.struct(part(1).alias("file"), start.alias("start"), F.coalesce(part(3).try_cast("int"), start).alias("end")))


def valid_slug(x: Column) -> Column:
    return x.rlike(r"^[a-z0-9]+(?:-[a-z0-9]+)*$")


def valid_namespace(x: Column) -> Column:
    return x.rlike(rf"^{C.LABEL_ID}$")


def cosine(a: Column, b: Column) -> Column:
    """In doubles; 0 for unequal widths, empty vectors or a zero norm."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def verdict(similarity: Column, shared: Column, coverage: Column, draft_terms: Column) -> Column:
    """Bands, first match wins; coverage counts only for drafts of enough terms."""
    cov = F.when(draft_terms < C.MIN_DRAFT_TERMS, F.lit(0.0)).otherwise(coverage)
    sim, none = F.coalesce(similarity, F.lit(-1.0)), similarity.isNull()
    return (
        F.when(sim >= C.SIM_DUPLICATE, "duplicate")
        .when((sim >= C.SIM_DUPLICATE_FACET) & (shared > 0), "duplicate")
        .when(none & (shared >= 2) & (cov >= C.COVERAGE_RELATED), "duplicate")
        .when(none & (cov >= C.COVERAGE_DUPLICATE), "duplicate")
        .when((sim >= C.SIM_RELATED) | (shared > 0) | (cov >= C.COVERAGE_RELATED), "related")
        .otherwise("weak")
    )


def embedding_status(stored: Column, body: Column) -> Column:
    return F.when(stored.isNull(), "missing").when(stored == F.sha2(body, 256), "fresh").otherwise("stale")
