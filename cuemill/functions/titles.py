"""Release and title features as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
RELEASE_SPELLINGS = (
    ("WEB-DL", "WEBDL"), ("WEB.DL", "WEBDL"), ("WEB DL", "WEBDL"), ("WEB-RIP", "WEBRIP"), ("WEB.RIP", "WEBRIP"),
    ("BLU-RAY", "BLURAY"), ("BLU.RAY", "BLURAY"), ("H.264", "H264"), ("H.265", "H265"), ("TELE-SYNC", "TELESYNC"),
)
DISC_SOURCES = ("BLURAY", "BDRIP", "REMUX")
THEATRICAL_SOURCES = ("CAM", "HDCAM", "TS", "HDTS", "TC", "HDTC", "TELESYNC", "TELECINE")
EDITIONS = (
    ("director", r"\bdirector(?:'s|s)?[ ._-]+cut\b"), ("extended", r"\bextended(?:[ ._-]+(?:cut|edition))?\b"),
    ("final", r"\bfinal[ ._-]+cut\b"), ("theatrical", r"\btheatrical(?:[ ._-]+cut)?\b"),
    ("ultimate", r"\bultimate[ ._-]+cut\b"), ("unrated", r"\bunrated(?:[ ._-]+(?:cut|edition))?\b"),
)
SOURCE_LABELS = (
    ("REMUX", "REMUX"), ("BLURAY", "Blu-ray"), ("BDRIP", "BDRip"), ("WEBDL", "WEB-DL"), ("WEBRIP", "WEBRip"), ("HDTV", "HDTV"), ("DVDRIP", "DVDRip"),
)
TECHNICAL_TOKENS = "uhd|bluray|bdrip|remux|webdl|webrip|hdtv|dvdrip|x264|x265|h264|h265|hevc|avc|(?:480|576|720|1080|2160|4320)[pi]"
TECHNICAL = (
    r"(?i)(?<![\p{L}\p{N}])(?:4K|UHD|2160p|1080p|720p|Blu[- .]?Ray|WEB[- .]?DL|WEBRip|BDRip|HDR|DV|"
    r"x26[45]|H\.?26[45]|REMUX|AAC|DDP?\d?(?:\.\d)?|Atmos)(?![\p{L}\p{N}])")
YEAR = r"(?<!\d)(?:19\d{2}|20\d{2})(?!\d)"
FILE_SUFFIX = r"(?i)\.(?:mkv|mp4|m4v|avi|mov|ts|m2ts|webm|wmv|srt|ass|ssa|vtt|sub|txt)$"
ROMAN = {"I": "1", "II": "2", "III": "3", "IV": "4", "V": "5", "VI": "6", "VII": "7", "VIII": "8", "IX": "9", "X": "10"}
NOISE_TOKENS = ("en", "eng", "english", "subtitle", "subtitles", "sub", "srt", "ass", "ssa", "vtt", "utf8", "utf", "8")
RECUTS = (
    ("despecialized", r"\bde\s*speciali[sz]ed\b"), ("fan_edit", r"\bfan\s*(?:edit|cut|edition)\b"),
    ("recut", r"\bre\s*(?:cut|edit(?:ed)?)\b"), ("revisited", r"\brevisited\b"),
)
STOPWORDS = ("the", "a", "an", "of", "and", "in", "on", "to", "for", "part")


def _list(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _extract(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def release_tags(text: Column) -> Column:
    """Distinct upper-case tags of a release name, spellings unified."""
    value = F.upper(text)
    for old, new in RELEASE_SPELLINGS:
        value = F.replace(value, F.lit(old), F.lit(new))
    return F.array_distinct(_extract(value, "[A-Z0-9]+"))


def director_tag(text: Column) -> Column:
    """`DC` next to a technical tag and after a release year."""
    tokens = F.concat(F.lit(" "), F.array_join(_extract(F.lower(text), "[a-z0-9]+"), " "), F.lit(" "))
    return tokens.rlike(r" (?:19|20)\d{2} (?:.* )?dc (?:" + TECHNICAL_TOKENS + ") ") | tokens.rlike(
        r" (?:19|20)\d{2} (?:.* )?(?:" + TECHNICAL_TOKENS + r") dc (?:(?:mkv|mp4|avi|srt|ass|ssa) .*)?$")


def editions(text: Column) -> Column:
    lower = F.lower(text)
    found = [F.when(lower.rlike(p) | (director_tag(text) if n == "director" else F.lit(False)), n) for n, p in EDITIONS]
    return F.array_compact(F.array(*found))


def source_family(tags: Column) -> Column:
    return (
        F.when(F.arrays_overlap(tags, _list(DISC_SOURCES)), "disc").when(F.arrays_overlap(tags, _list(("WEBDL", "WEBRIP"))), "web")
        .when(F.arrays_overlap(tags, _list(("DVD", "DVDRIP"))), "dvd").when(F.array_contains(tags, "HDTV"), "hdtv").otherwise(""))


def release_group(text: Column) -> Column:
    stem = F.regexp_replace(text, r"(?i)\.(?:mkv|mp4|avi|m2ts|srt|ass|ssa|sub|zip|txt)$", "")
    group = F.lower(F.regexp_extract(stem, r"(?i)-([a-z0-9][a-z0-9_]{1,31})$", 1))
    technical = F.arrays_overlap(release_tags(text), _list(("X264", "X265", "H264", "H265", "HEVC", "BLURAY", "WEBDL", "WEBRIP")))
    plain = group.isin("dl", "rip", "ray", "hd", "ma", "aac", "hevc", "x264", "x265")
    return F.when(technical & ~plain, group).otherwise("")


def tidy_title(text: Column) -> Column:
    text = F.regexp_replace(text, r"[._]+", " ")
    text = F.regexp_replace(text, r"(?i)\[[^\]]*\]|【[^】]*】|\([^)]*(?:www\.|@)[^)]*\)", " ")
    text = F.regexp_replace(text, r"\s+", " ")
    return F.regexp_replace(text, r"^[ \-._(\[{<]+|[ \-._(\[{<]+$", "")


def parse_filename(name: Column, newest_year: Column) -> Column:
    """(title, year, confidence) of a file name. Digits that belong to the title are not the year.

    The last year before the technical part counts if something precedes it and either brackets,
    a dot or underscore, or a technical tag mark it as release data.
    """
    raw = F.regexp_replace(F.regexp_replace(F.trim(name), r"^.*[/\\]", ""), FILE_SUFFIX, "")
    technical = raw.rlike(TECHNICAL)
    content = F.trim(F.regexp_replace(raw, "(?s)" + TECHNICAL + ".*$", ""))
    years, parts = _extract(content, YEAR), F.split(content, YEAR)
    n = F.size(years)

    def upto(i):
        """Text before the i-th year."""
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(i, F.lit(1))), lambda j: F.concat(
            F.element_at(parts, j), F.when(j < i, F.element_at(years, j)).otherwise("")))
        return F.array_join(pairs, "")

    def usable(i):
        before, after = upto(i), F.element_at(parts, i + 1)
        named = F.regexp_replace(before, r"^[ \-._(\[{<]+|[ \-._(\[{<]+$", "").rlike(r"[\p{L}\p{N}]")
        wrapped = before.rlike(r"[\[(]\s*$") & after.rlike(r"^\s*[)\]]")
        dated = technical | before.rlike(r"[._]\s*$") | wrapped
        return named & dated & (wrapped | (F.element_at(years, i).cast("int") <= newest_year + 1))

    places = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & usable(i))
    last = F.try_element_at(places, F.lit(-1))
    wrapped = upto(last).rlike(r"[\[(]\s*$") & F.element_at(parts, last + 1).rlike(r"^\s*[)\]]")
    return F.struct(
        F.when(last.isNotNull(), tidy_title(upto(last))).otherwise(tidy_title(content)).alias("title"),
        F.when(last.isNotNull(), F.element_at(years, F.coalesce(last, F.lit(1)))).otherwise("").alias("year"),
        F.when(last.isNull(), "unknown").when(wrapped, "explicit").otherwise("inferred").alias("confidence"))


def title_tokens(title: Column) -> Column:
    """Comparable title tokens: descriptors, connectors and leading articles off, roman numbers arabic."""
    value = F.regexp_replace(title, r"^\s*(?:19|20)\d{2}\s+[-–—]\s+", "")
    value = F.regexp_replace(value, r"(?i)(?:\s*\((?:live action|animated|animation|theatrical|theatrical cut|extended|extended edition|director'?s? cut)\)\s*)+$", "")
    value = F.regexp_replace(F.regexp_replace(value, "[’']", ""), r"\s*\((?:19|20)\d{2}\)\s*$", "")
    raw = _extract(F.upper(value), "[A-Z0-9]+")
    roman = F.create_map(*[F.lit(x) for pair in ROMAN.items() for x in pair])
    n = F.size(raw)

    def plain(token, i):
        following, previous = F.get(raw, i + 1), F.get(raw, i - 1)
        connector = (token == "X") & (i > 0) & (i < n - 1) & following.rlike("^[A-Z]+$") & ~following.isin(
            "BLURAY", "BDRIP", "REMUX", "WEB", "WEBRIP", "HDR") & ~previous.isin("EPISODE", "EP", "PART", "CHAPTER")
        return F.when(connector, token).otherwise(F.coalesce(roman[token], token))

    tokens = F.filter(F.transform(raw, plain), lambda t: t != "AND")
    text = F.concat(F.array_join(tokens, " "), F.lit(" "))
    text = F.trim(F.regexp_replace(text, "^(?:(?:THE|A|AN) )+", ""))
    return F.filter(F.split(text, " "), lambda t: t != "")


def title_key(title: Column) -> Column:
    """Literal words of a title, articles and connectors kept."""
    value = F.regexp_replace(F.lower(title), r"^\s*(?:19|20)\d{2}\s+[-–—]\s+", "")
    return F.array_join(_extract(F.regexp_replace(value, r"\s*\((?:19|20)\d{2}\)\s*$", ""), r"[\p{L}\p{N}]+"), " ")


def query_variants(title: Column) -> Column:
    """The title with `and` and `&` exchanged."""
    base = F.trim(F.regexp_replace(title, r"\s+", " "))
    swapped = [F.regexp_replace(base, r"(?i)\s+and\s+", " & "), F.trim(F.regexp_replace(F.regexp_replace(base, r"\s*&\s*", " and "), r"\s+", " "))]
    return F.array_distinct(F.filter(F.array(base, *swapped), lambda t: t != ""))


def connector_alias(title: Column) -> Column:
    """The title with its only VS or X exchanged, if three words follow it; else null."""
    w = _extract(F.upper(title), "[A-Z0-9]+")
    at = F.array_position(F.transform(w, lambda t: t.isin("VS", "X")), F.lit(True)).cast("int")
    single = F.size(F.filter(w, lambda t: t.isin("VS", "X"))) == 1
    changed = F.transform(w, lambda t: F.when(t == "VS", "X").when(t == "X", "VS").otherwise(t))
    return F.when(single & (at > 1) & (at - 1 < F.size(w) - 3), F.array_join(changed, " "))


def camel_split(title: Column) -> Column:
    return F.regexp_replace(title, "(?<=[a-z])(?=[A-Z])", " ")


_SMALL = [
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve",
    "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
]
_TENS = [
    "-", "-", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety",
]


def number_words(text: Column) -> Column:
    """English readings of a bare number 0..9999, at most two."""
    n = text.cast("int")
    small, tens = _list(_SMALL), _list(_TENS)

    def below_100(v):
        v = v.cast("int")
        return F.when(v < 20, F.get(small, v)).otherwise(F.concat(
            F.get(tens, F.floor(v / 10).cast("int")), F.when(v % 10 > 0, F.concat(F.lit(" "), F.get(small, v % 10))).otherwise("")))

    def below_1000(v):
        v = v.cast("int")
        return F.when(v < 100, below_100(v)).otherwise(F.concat(
            F.get(small, F.floor(v / 100).cast("int")), F.lit(" hundred"), F.when(v % 100 > 0, F.concat(F.lit(" "), below_100(v % 100))).otherwise("")))

    cardinal = F.when(n < 1000, below_1000(n)).otherwise(F.concat(
        below_1000(F.floor(n / 1000)), F.lit(" thousand"), F.when(n % 1000 > 0, F.concat(F.lit(" "), below_1000(n % 1000))).otherwise("")))
    tail = n % 100
    yearly = F.when(n.between(1100, 1999) | n.between(2010, 2099), F.concat(
        below_100(F.floor(n / 100)), F.lit(" "), F.when(tail == 0, "hundred").when(tail < 10, F.concat(F.lit("oh "), F.get(small, tail))).otherwise(below_100(tail))))
    good = text.rlike("^(?:0|[1-9][0-9]{0,3})$")
    return F.when(good, F.array_distinct(F.array_compact(F.array(yearly, cardinal)))).otherwise(F.array().cast("array<string>"))


_NUMERAL = "[1-9]\\d?|VIII|VII|VI|IV|IX|III|II|I|V|X"


def sequel_number(title: Column) -> Column:
    """Explicit installment number of a title; empty if there is none."""
    text = F.trim(F.regexp_replace(title, r"\b(?:19|20)\d{2}\b", ""))
    # Fixed patterns: labels with a number, else a bare number or a final numeral. The leftmost match counts; its groups
    # exclude each other, so joining them gives the one that matched.
    def leftmost(pattern: str, groups: int) -> Column:
        return F.concat(*[F.regexp_extract(text, pattern, k + 1) for k in range(groups)])

    labelled = leftmost(rf"(?i)(?:第\s*([1-9]\d?)\s*[部集章]|\b(?:episode|ep\.?|part|chapter)\s*[:._ -]*({_NUMERAL})\b)", 2)
    loose = leftmost(r"(?i)(?:[\u3400-\u9fff]\s*([1-9]\d?)\s*$|\b([1-9]\d?)\b|\b(VIII|VII|VI|IV|IX|III|II|V|X)\s*$)", 3)
    value = F.upper(F.when(labelled != "", labelled).otherwise(loose))
    roman = F.create_map(*[F.lit(x) for pair in ROMAN.items() for x in pair])
    return F.coalesce(roman[value], value)


def series_base(title: Column) -> Column:
    text = F.trim(F.regexp_replace(title, r"\b(?:19|20)\d{2}\b", ""))
    text = F.regexp_replace(text, rf"(?i)(?:第\s*[1-9]\d?\s*[部集章]|\b(?:episode|ep\.?|part|chapter)\s*[:._ -]*(?:{_NUMERAL}))\s*$", "")
    text = F.regexp_replace(text, r"(?i)(?:[1-9]\d?|\b(?:VIII|VII|VI|IV|IX|III|II|I|V|X))\s*$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^[ :：._-]+|[ :：._-]+$", ""))


def provider_id(value: Column) -> Column:
    """Digits of a provider id without prefix and leading zeros; empty if it is no id."""
    bare = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), "(?i)^tt", "")
    return F.when(bare.rlike("^[0-9]+$"), F.regexp_replace(bare, "^0+", "")).otherwise("")


def media_specification(name: Column, duration_s: Column, size_bytes: Column) -> Column:
    stem = F.regexp_replace(name, r"\.[A-Za-z0-9]{2,4}$", "")
    tags, total = release_tags(stem), F.bround(duration_s).cast("long")
    source = F.when(F.lit(False), "")
    for code, label in SOURCE_LABELS:
        source = source.when(F.array_contains(tags, code), label)
    edition = F.array_join(editions(stem), "/")
    clock = F.format_string("%d:%02d:%02d", F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60)
    return F.concat_ws(
        " · ", F.when(edition == "", "edition unmarked").otherwise(edition), source.otherwise("source unmarked"),
        F.when(duration_s > 0, clock), F.when(size_bytes >= 0, F.format_string("%.2fG", size_bytes / (1024.0 ** 3))),
        F.when(F.array_contains(tags, "IMAX"), "IMAX"), F.when(stem.rlike(r"(?i)\bopen[ ._-]*matte\b"), "Open Matte"),
        F.when(stem.rlike(r"(?i)\b120\s*fps\b"), "120fps"))


def duplicate_key(text: Column, hearing_impaired: Column) -> Column:
    """Cross-provider key of a release or file name; null if it says too little."""
    value = F.lower(F.coalesce(text, F.lit("")))
    value = F.regexp_replace(value, r"(?:\.(?:zip|rar|7z|gz|srt|ass|ssa|vtt|sub)){1,3}$", "")
    kept = F.filter(_extract(value, r"[\p{L}\p{N}]+"), lambda t: ~t.isin(*NOISE_TOKENS))
    joined = F.array_join(kept, " ")
    return F.when((F.size(kept) >= 3) | (F.length(joined) >= 20), F.concat(F.when(hearing_impaired, "hi|").otherwise("std|"), joined))


def candidate_key(provider: Column, file_id: Column, url: Column, release: Column, file_name: Column) -> Column:
    head = F.lower(F.trim(provider))
    named = F.coalesce(F.nullif(F.trim(file_id), F.lit("")), F.concat_ws("|", F.trim(release), F.trim(file_name)))
    return F.when(F.length(F.trim(F.coalesce(url, F.lit("")))) > 0, F.concat_ws("|", head, F.trim(file_id), F.trim(url))).otherwise(
        F.concat_ws("|", head, F.lower(named)))


def catalogue_queries(title: Column, year: Column) -> Column:
    """Search texts: exact, connector alias, first two content words, every leave-one-out."""
    exact = F.trim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", " "))
    content = F.filter(F.split(exact, " "), lambda t: ~t.isin(*STOPWORDS) & ~t.rlike("^[0-9]+$") & (t != ""))
    n = F.size(content)
    dated = lambda words: F.concat_ws(" ", F.array_join(words, " "), F.nullif(year, F.lit("")))
    broad = F.when(n > 0, dated(F.slice(content, 1, 2)))
    without = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when(
        n >= 2, dated(F.filter(content, lambda t, j: j + 1 != i))))
    return F.array_distinct(F.filter(F.concat(F.array(exact, F.lower(connector_alias(exact)), broad), without), lambda t: t.isNotNull() & (t != "")))


# Conflicts: each is empty or the reason ------------------------------------------------------


def release_metadata(value: Column, titles: Column) -> Column:
    """A release or file name less the longest of the known film titles (an array) that it begins with, so that the title's
    words and numbers are taken for no label. Words in the title's place only: a label of the same words stays behind it.
    Case and what stands between words do not matter; null or wordless titles are passed over."""
    words = F.filter(F.transform(titles, lambda t: _extract(t, r"[\p{L}\p{N}]+")), lambda w: F.size(w) > 0)
    begins = lambda w: F.concat(F.lit(r"(?i)^[^\p{L}\p{N}]*"), F.array_join(w, r"[^\p{L}\p{N}]+"), F.lit(r"(?![\p{L}\p{N}])"))
    fits = F.filter(F.transform(words, begins), lambda p: F.regexp_like(value, p))
    longest = F.array_max(F.transform(fits, lambda p: F.struct(F.char_length(p).alias("n"), p.alias("p"))))["p"]
    return F.when(longest.isNull(), value).otherwise(F.regexp_replace(value, F.coalesce(longest, F.lit("$")), F.lit("")))


def source_conflict(own: Column, other: Column, titles: Column | None = None) -> Column:
    """A disc's own file against subtitles of a theatrical recording; `titles` (an array) are no part of either name."""
    return source_clash(has_source(own, DISC_SOURCES, titles), has_source(other, THEATRICAL_SOURCES, titles))


def has_source(text: Column, sources, titles: Column | None = None) -> Column:
    return F.arrays_overlap(release_tags(text if titles is None else release_metadata(text, titles)), _list(sources))


def source_clash(disc: Column, theatrical: Column) -> Column:
    return F.when(disc & theatrical, "theatrical_source").otherwise("")


def edition_conflict(own: Column, other: Column) -> Column:
    return edition_clash(editions(own), editions(other))


def edition_clash(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b), "edition").otherwise("")


def recut_conflict(own: Column, other: Column, title: Column) -> Column:
    return recut_clash(recut_labels(own, title), recut_labels(other, title))


def recut_labels(text: Column, title: Column) -> Column:
    """Recut labels of a name that are no part of the title."""
    def spaced(value):
        return F.trim(F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]+", " "))

    return F.array_compact(F.array(*[F.when(spaced(text).rlike(p) & ~spaced(title).rlike(p), n) for n, p in RECUTS]))


def recut_clash(a: Column, b: Column) -> Column:
    specific = _list(("despecialized", "revisited"))
    sa, sb = F.array_intersect(a, specific), F.array_intersect(b, specific)
    fine = (F.size(b) == 0) | (a == b) | ((F.size(sb) > 0) & (sa == sb))
    return F.when(fine, "").otherwise("recut")


def year_conflict(own_year: Column, release: Column, feature_year: Column) -> Column:
    return year_clash(year_number(own_year), stated_years(release), site_year(feature_year))


def year_number(year: Column) -> Column:
    return F.nullif(year, F.lit("")).cast("int")


def stated_years(release: Column) -> Column:
    return _extract(F.coalesce(release, F.lit("")), YEAR).cast("array<int>")


def site_year(feature_year: Column) -> Column:
    return F.when(feature_year.rlike(r"^(?:19|20)\d{2}$"), feature_year.cast("int"))


def year_clash(own: Column, years: Column, site: Column) -> Column:
    far = (F.array_min(years) <= own - 2) | (F.array_max(years) >= own + 2)
    near = F.array_contains(years, own - 1) | F.array_contains(years, own) | F.array_contains(years, own + 1)
    stated = F.coalesce(far & ~near, F.lit(False))
    listed = F.coalesce((F.size(years) == 0) & (F.abs(site - own) >= 2), F.lit(False))
    return F.when(own.isNull(), "").when(stated, "release_year").when(listed, "site_year").otherwise("")


def language_label_conflict(text: Column) -> Column:
    value = F.regexp_replace(F.lower(text), r"[\[\](){}]", " ")
    mixed = value.rlike(r"\b(?:multi[ ._-]*(?:lang(?:uage)?s?|lingual|sub(?:title)?s?)|bilingual|dual[ ._-]*sub(?:title)?s?)\b")
    paired = value.rlike(r"\b(?:en|eng|english)\s*[+&,/_.-]\s*(?:fr|fre|fra|french|de|ger|deu|german|es|spa|spanish|it|ita|pt|por|ru|rus|zh|chi|zho)\b")
    return F.when(mixed, "multi_language").when(paired, "mixed_label").otherwise("")


def container_conflict(file_year: Column, container_year: Column) -> Column:
    gap = F.abs(F.nullif(file_year, F.lit("")).cast("int") - F.nullif(container_year, F.lit("")).cast("int"))
    return F.when(F.coalesce(gap >= 2, F.lit(False)), "container_year").otherwise("")


def installment_conflict(title: Column, release: Column) -> Column:
    def episode(text):
        found = F.upper(F.regexp_extract(text, r"(?i)\b(?:episode|ep\.?|star[ ._-]+wars)[ .:_-]*(viii|vii|vi|iv|ix|iii|ii|i|v|[1-9])\b", 1))
        roman = F.create_map(*[F.lit(x) for pair in ROMAN.items() for x in pair])
        return F.nullif(F.coalesce(roman[found], found), F.lit(""))

    return F.when(F.coalesce(episode(title) != episode(release), F.lit(False)), "installment").otherwise("")
