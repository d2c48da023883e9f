"""Catalogue and identity jobs: matching candidates to works without guessing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.functions import titles as tt
from cuemill.functions.tracks import subtitle_role


def id_match(pairs: list[tuple[Column, Column]]) -> tuple[Column, Column]:
    """(all comparable ids agree, some comparable id differs); absent ids are no vote."""
    both = [(a != "") & (b != "") for a, b in pairs]
    agree = [~c | (a == b) for c, (a, b) in zip(both, pairs)]
    any_both, all_agree, differ = F.lit(False), F.lit(True), F.lit(False)
    for c, ok in zip(both, agree):
        any_both, all_agree, differ = any_both | c, all_agree & ok, differ | ~ok
    return any_both & all_agree, differ


def title_year_kinds(candidates: DataFrame, identities: DataFrame) -> DataFrame:
    """(year, feature_title, title, kind) of all different titles of one year that are equal, differ by a one-letter typo, or
    of which one is the start of the other.

    Typos meet on deletion-neighbourhood keys (a token with one letter left out), prefixes on every leading part of the
    longer title, so both stay equi-joins. Only different titles meet, so this work does not grow with the films that share
    one. Exploded rows are joined by merging: their size is not known when the plan is made, and none may go to the driver.
    """
    c = candidates.select("feature_title", F.col("feature_year").alias("year")).distinct().withColumn("c_tokens", tt.title_tokens(F.col("feature_title"))).filter(F.size("c_tokens") > 0)
    i = identities.select("title", "year").distinct().withColumn("i_tokens", tt.title_tokens(F.col("title"))).filter(F.size("i_tokens") > 0)
    key = lambda tokens: F.array_join(tokens, " ")
    found = ["year", "feature_title", "title"]
    whole_i = i.withColumn("k", key(F.col("i_tokens")))
    exact = c.withColumn("k", key(F.col("c_tokens"))).join(whole_i.hint("merge"), ["year", "k"]).select(*found, F.lit("exact").alias("kind"))

    def neighbourhood(df, tokens):
        at = df.select("*", F.posexplode(tokens).alias("at", "token")).filter(~F.col("token").rlike("^[0-9]+$"))
        shorter = F.transform(F.sequence(F.lit(1), F.length("token")), lambda p: F.concat(
            F.substring("token", F.lit(1), p - 1), F.substring("token", p + 1, F.length("token"))))
        forms = F.array_distinct(F.concat(F.array("token"), shorter))
        rest = F.array_join(F.transform(tokens, lambda t, j: F.when(j == F.col("at"), "*").otherwise(t)), " ")
        return at.withColumn("rest", rest).withColumn("form", F.explode(forms))

    cn = neighbourhood(c, F.col("c_tokens")).select("feature_title", "year", "at", "rest", "form", F.col("token").alias("c_token"))
    ini = neighbourhood(i, F.col("i_tokens")).select("title", "year", "at", "rest", "form", F.col("token").alias("i_token"))
    typo = cn.join(ini.hint("merge"), ["year", "at", "rest", "form"]).filter(F.levenshtein("c_token", "i_token") == 1).select(
        *found, F.lit("typo").alias("kind")).distinct()

    def proper_prefixes(df, tokens):
        return df.withColumn("n", F.explode(F.when(F.size(tokens) > 1, F.sequence(F.lit(1), F.size(tokens) - 1)))).withColumn(
            "k", key(F.slice(tokens, 1, F.col("n"))))

    longer_i = c.withColumn("k", key(F.col("c_tokens"))).join(proper_prefixes(i, F.col("i_tokens")).hint("merge"), ["year", "k"])
    longer_c = proper_prefixes(c, F.col("c_tokens")).join(whole_i.hint("merge"), ["year", "k"])
    prefix = longer_i.select(*found).unionByName(longer_c.select(*found)).withColumn("kind", F.lit("prefix"))
    return exact.unionByName(typo).unionByName(prefix)


def with_members(met: DataFrame, candidates: DataFrame, works: DataFrame) -> DataFrame:
    """All candidates and works of pairs of titles `met(year, feature_title, title, ...)`. Pairs leave the last join as they
    are, so nothing may be shuffled by pair behind it."""
    near = met.join(candidates.withColumnRenamed("feature_year", "year").hint("merge"), ["feature_title", "year"])
    return near.join(works.hint("merge"), ["title", "year"])


def title_year_join(candidates: DataFrame, identities: DataFrame) -> DataFrame:
    """Candidate-work pairs of one year by equal title, by one-letter typo, or by title prefix. Titles meet first
    (`title_year_kinds`), and the films that bear them are joined to the result."""
    return with_members(
        title_year_kinds(candidates, identities), candidates.select("file_id", "feature_title", "feature_year"),
        identities.select("identity_id", "title", "year")).select("file_id", "identity_id", "kind")


def shared_id_issues(ids: DataFrame, work: str = "work_id") -> DataFrame:
    """Works that share a provider id with another work. `ids(work_id, namespace, id)`."""
    clean = ids.filter("id <> ''").select(work, "namespace", "id").distinct()
    shared = clean.groupBy("namespace", "id").agg(F.min(work).alias("lo"), F.max(work).alias("hi")).filter("lo <> hi").select("namespace", "id")
    return clean.join(shared, ["namespace", "id"]).select(work, "namespace", "id", F.lit("shared_provider_id").alias("issue"))


def prefix_profiles(profiles: DataFrame, identities: DataFrame) -> DataFrame:
    """Film profiles with both ids whose title or alias is the title of a work of that year, or whose title is a proper
    prefix (two tokens up) of it. A profile without a kind counts as a film. Different names meet first, once for all
    profiles and works that bear them; no pair of these is shuffled."""
    ready = profiles.filter("lower(kind) in ('movie', 'feature', '') and imdb_id <> '' and tmdb_id <> ''").select(
        "profile_id", "year", tt.title_key(F.col("title")).alias("k"), F.array_sort(F.array_distinct(F.transform("aliases", tt.title_key))).alias("a")).distinct()
    works = identities.select("identity_id", "year", tt.title_key(F.col("title")).alias("work")).distinct()
    wanted = works.select("year", "work").distinct()
    words = F.split("work", " ")
    heads = wanted.withColumn("n", F.explode(F.when(F.size(words) > 2, F.sequence(F.lit(2), F.size(words) - 1)))).select(
        "year", "work", F.array_join(F.slice(words, 1, F.col("n")), " ").alias("name"))
    names = ready.select("year", "k", "a").distinct()
    by_prefix = names.withColumn("name", F.col("k")).join(heads.hint("merge"), ["year", "name"])
    by_alias = names.withColumn("name", F.explode(F.array_append("a", F.col("k")))).join(wanted.withColumn("name", F.col("work")).hint("merge"), ["year", "name"])
    met = by_prefix.select("year", "k", "a", "work").unionByName(by_alias.select("year", "k", "a", "work")).distinct()
    return met.join(ready.hint("merge"), ["year", "k", "a"]).join(works.hint("merge"), ["year", "work"]).select("profile_id", "identity_id")


def consistent_parents(rows: DataFrame, parent: str, facts: list[str]) -> DataFrame:
    """Parents whose echoed rows agree on every fact (an absent fact is no vote), with the agreed values."""
    filled = [F.nullif(F.col(f).cast("string"), F.lit("")) for f in facts]
    agg = rows.groupBy(parent).agg(
        F.count(F.lit(1)).alias("rows"),
        *[x for f, v in zip(facts, filled) for x in (F.min(v).alias(f"_lo_{f}"), F.max(v).alias(f"_hi_{f}"))])
    agree = F.lit(True)
    for f in facts:
        agree = agree & F.coalesce(F.col(f"_lo_{f}") == F.col(f"_hi_{f}"), F.lit(True))
    return agg.filter(agree).select(parent, "rows", *[F.col(f"_lo_{f}").alias(f) for f in facts])


def funnel(screened: DataFrame, totals: DataFrame, by: str = "provider", weight: str | None = None) -> DataFrame:
    """Loaded, filtered by reason, pending and queued candidates per provider, with what the provider says it has.

    `totals(by, total, truncated)`: a total below what was loaded, or none, is unknown; `truncated` tells that results
    remain unloaded. Providers that returned nothing are listed with zeros. A row stands for as many as its column `weight` says.
    """
    each = F.col(weight) if weight else F.lit(1)
    sums = {"loaded": each, **{n: F.when(F.col("reason") == r, each) for n, r in (
        ("queued", ""), ("pending", "pending"), *[(f"by_{r}", r) for r in ("duplicate", "role", "identity", "release")])}}
    counts = screened.groupBy(by).agg(*[F.sum(c).cast("long").alias(n) for n, c in sums.items()])
    names = list(sums)
    rows = counts.join(totals, by, "full_outer").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in names})
    filtered = F.col("loaded") - F.col("queued") - F.col("pending")
    return rows.select(by, F.when(F.col("total") >= F.col("loaded"), F.col("total")).alias("total"), *names, filtered.alias("filtered"), F.coalesce("truncated", F.lit(False)).alias("truncated"))


def build_works(claims: DataFrame) -> DataFrame:
    """One row per entity from catalogue claims: ids, years, runtime, and issues instead of picks.

    `claims(entity, property, statement, rank, value, unit, precision, qualifier)`, one row per
    claim and qualifier. Distinct values are counted through minimum and maximum.
    """
    live = claims.filter("rank <> 'deprecated'")
    def of(prop, value=F.col("value")):
        return F.when(F.col("property") == prop, value)

    usable_year = F.when((F.col("precision") >= 9) & F.col("value").rlike(r"^\+?\d{4}-"), F.regexp_extract("value", r"(\d{4})", 1))
    minutes = F.when((F.col("unit") == "minute") & F.col("value").rlike(r"^\+?\d+(\.\d+)?$"), F.regexp_replace("value", r"^\+", "").cast("double") * 60)
    agg = live.groupBy("entity").agg(
        F.min(of("imdb")).alias("imdb_lo"), F.max(of("imdb")).alias("imdb_hi"), F.min(of("tmdb")).alias("tmdb_lo"), F.max(of("tmdb")).alias("tmdb_hi"),
        F.min(of("year", usable_year)).alias("year_lo"), F.max(of("year", usable_year)).alias("year_hi"),
        F.bool_or(F.coalesce(of("year", usable_year.isNull()), F.lit(False))).alias("year_vague"),
        F.bool_and(of("type", F.col("value") == "film")).alias("is_film"),
        F.min(of("runtime", minutes)).alias("runtime_lo"), F.max(of("runtime", minutes)).alias("runtime_hi"),
        F.bool_or(F.coalesce(of("runtime", minutes.isNull()), F.lit(False))).alias("runtime_odd"),
        F.bool_or(F.coalesce(of("runtime", F.col("qualifier").isNotNull()), F.lit(False))).alias("runtime_qualified"))
    def one(name):
        return F.col(f"{name}_lo") == F.col(f"{name}_hi")

    issues = F.array_compact(F.array(
        F.when(F.col("imdb_lo").isNull(), "missing_imdb").when(~one("imdb"), "conflicting_imdb"),
        F.when(F.col("tmdb_lo").isNull(), "missing_tmdb").when(~one("tmdb"), "conflicting_tmdb"),
        F.when(F.col("year_vague"), "year_not_precise"), F.when(~F.coalesce(one("year"), F.lit(False)), "year_conflict_or_missing"),
        F.when(~F.coalesce("is_film", F.lit(False)), "missing_or_non_movie_type"),
        F.when(F.col("runtime_qualified"), "runtime_qualified"), F.when(F.col("runtime_odd"), "runtime_unit"),
        F.when(~F.coalesce(one("runtime"), F.lit(False)), "missing_or_multiple_runtime")))
    return agg.select(
        "entity", F.when(one("imdb"), F.col("imdb_lo")).alias("imdb_id"), F.when(one("tmdb"), F.col("tmdb_lo")).alias("tmdb_id"),
        F.when(one("year"), F.col("year_lo")).alias("year"),
        F.when(one("runtime") & ~F.col("runtime_odd") & ~F.col("runtime_qualified"), F.col("runtime_lo")).alias("runtime_s"),
        F.array_join(issues, ",").alias("issues"))


def resolve_unique(observations: DataFrame, expected: str = "identity_id", weight: str | None = None) -> DataFrame:
    """Confirm a work only if all its evidence names one id pair and nothing contradicts it.

    `observations(identity_id, imdb_id, tmdb_id, conflict)`; conflicting rows are counted, never dropped.
    A row stands for as many as its column `weight` says.
    """
    each = F.col(weight) if weight else F.lit(1)
    pair = F.when((F.col("imdb_id") != "") & (F.col("tmdb_id") != ""), F.struct("imdb_id", "tmdb_id"))
    agg = observations.groupBy(expected).agg(
        F.sum(each).cast("long").alias("observed"), F.sum(F.when(pair.isNotNull(), each).otherwise(0)).cast("long").alias("complete"), F.min(pair).alias("lo"), F.max(pair).alias("hi"),
        F.min(F.nullif("imdb_id", F.lit(""))).alias("i_lo"), F.max(F.nullif("imdb_id", F.lit(""))).alias("i_hi"),
        F.min(F.nullif("tmdb_id", F.lit(""))).alias("t_lo"), F.max(F.nullif("tmdb_id", F.lit(""))).alias("t_hi"), F.bool_or("conflict").alias("conflict"))
    rival = F.coalesce(F.col("i_lo") != F.col("i_hi"), F.lit(False)) | F.coalesce(F.col("t_lo") != F.col("t_hi"), F.lit(False))
    reason = F.when(F.col("conflict"), "conflicting_observation").when(rival, "several_works").when(F.col("complete") == 0, "incomplete_ids").otherwise("")
    return agg.select(expected, "observed", "complete", F.when(reason == "", "confirmed").otherwise("pending").alias("state"), reason.alias("reason"),
                      F.when(reason == "", F.col("lo.imdb_id")).alias("imdb_id"), F.when(reason == "", F.col("lo.tmdb_id")).alias("tmdb_id"))


#: Kinds of feature that may be a film; others speak against it.
FILM_TYPES = ("movie", "feature", "")


def resolve_profiles(works: DataFrame, profiles: DataFrame, official: DataFrame) -> DataFrame:
    """One work or none for each film name, from profiles that catalogues have returned.

    `works(identity_id, key, year)` with the expected title key; `profiles(profile_id, source, keys, year, imdb_id, tmdb_id,
    kind)` with the keys of a title and its aliases, sources `primary`, `primary_incomplete` and `secondary`;
    `official(tmdb_id, key, year)` from the public page of a work. Empty ids and years are unknown.

    Primary profiles of the expected key and year must name exactly one pair of ids, and nothing observed may contradict
    it: another id, another kind, or any primary profile that shares one of the two ids and differs in the other, in year
    or in kind, under whatever title. Where a secondary profile of both ids is one year off, shares a name and the one
    official page agrees with its year under a shared name, the year is corrected, and the two years count as the same.
    Every name of a profile is a row, so names meet by equal keys; conflicts meet by equal ids. The answer depends on key and
    year alone, so it is found once for each and joined to the works that bear them; profiles that are alike count once
    where only their presence matters.
    """
    primary = profiles.filter(F.col("source").isin("primary", "primary_incomplete"))
    odd = ~F.lower("kind").isin(*FILM_TYPES)
    some = lambda c: F.nullif(c, F.lit(""))
    named = primary.select("profile_id", "source", "year", "imdb_id", "tmdb_id", odd.alias("odd"), F.explode(F.array_distinct("keys")).alias("key"))
    pair = F.when((F.col("source") == "primary") & some("imdb_id").isNotNull() & some("tmdb_id").isNotNull(), F.struct("imdb_id", "tmdb_id"))
    asked = works.select("key", "year").distinct()
    seen = named.groupBy("key", "year").agg(
        F.count_if(F.col("source") == "primary").alias("exact"), F.min(pair).alias("lo"), F.max(pair).alias("hi"), F.bool_or("odd").alias("odd"),
        F.min(some("imdb_id")).alias("i_lo"), F.max(some("imdb_id")).alias("i_hi"), F.min(some("tmdb_id")).alias("t_lo"), F.max(some("tmdb_id")).alias("t_hi"))
    rivals = F.coalesce(F.col("i_lo") != F.col("i_hi"), F.lit(False)) | F.coalesce(F.col("t_lo") != F.col("t_hi"), F.lit(False))
    first = F.when(F.coalesce("exact", F.lit(0)) == 0, "no_profile").when(
        F.col("lo").isNull(), F.when(rivals | F.col("odd"), "competing_ids").otherwise("incomplete_ids")).when(
        F.col("lo") != F.col("hi"), "no_unique_pair").when(rivals | F.col("odd"), "competing_ids").otherwise("")
    told = asked.join(seen.hint("merge"), ["key", "year"], "left").select("key", "year", first.alias("reason"), "lo.imdb_id", "lo.tmdb_id")
    chosen = told.filter("reason = ''").drop("reason")

    # the year beside: both catalogues name the work, and its page decides
    mine = named.filter("source = 'primary' and not odd").select(F.col("key").alias("name"), "year", "imdb_id", "tmdb_id").distinct()
    theirs = profiles.filter("source = 'secondary' and lower(kind) = 'movie'").select(
        F.explode(F.array_distinct("keys")).alias("name"), F.col("year").alias("other"), "imdb_id", "tmdb_id").distinct()
    beside = chosen.join(mine, ["year", "imdb_id", "tmdb_id"]).join(theirs, ["name", "imdb_id", "tmdb_id"]).filter(F.abs(F.col("year").try_cast("int") - F.col("other").try_cast("int")) == 1)
    agreed = beside.join(official.select("tmdb_id", F.col("key").alias("name"), F.col("year").alias("other")).distinct(), ["tmdb_id", "name", "other"])
    # pages of one work with several years decide nothing
    one = agreed.groupBy("key", "year").agg(F.min("other").alias("other"), F.max("other").alias("last")).filter("other = last").select("key", "year", "other")

    wanted = chosen.join(one, ["key", "year"], "left").select("key", F.col("year").alias("asked"), "other", F.col("imdb_id").alias("imdb"), F.col("tmdb_id").alias("tmdb"))
    every = primary.select("year", "imdb_id", "tmdb_id", odd.alias("odd")).unionByName(
        profiles.filter("source = 'secondary'").select("year", "imdb_id", "tmdb_id", F.lit(None).cast("boolean").alias("odd"))).distinct()
    met = [wanted.join(every.filter(some(c).isNotNull()), F.col(c) == F.col(w)) for c, w in (("imdb_id", "imdb"), ("tmdb_id", "tmdb"))]
    other_id = F.coalesce(some("imdb_id") != F.col("imdb"), F.lit(False)) | F.coalesce(some("tmdb_id") != F.col("tmdb"), F.lit(False))
    # a secondary profile contradicts by its year alone, unless it is the one that corrects it
    other_year = F.coalesce(some("year") != F.col("asked"), F.lit(False)) & ~F.coalesce(F.col("odd").isNull() & (F.col("year") == F.col("other")), F.lit(False))
    against = met[0].unionByName(met[1]).filter(F.when(F.col("odd").isNull(), other_year).otherwise(other_id | other_year | F.col("odd"))).select("key", F.col("asked").alias("year")).distinct()
    marked = works.select("identity_id", "key", "year").join(told.join(one, ["key", "year"], "left").join(against.withColumn("against", F.lit(True)), ["key", "year"], "left").hint("merge"), ["key", "year"], "left")
    reason = F.when(F.col("reason") != "", F.col("reason")).when(F.col("against"), "conflicting_profile").otherwise("")
    good = reason == ""
    return marked.select(
        "identity_id", F.when(good, "confirmed").otherwise("pending").alias("state"), reason.alias("reason"), F.when(good, F.col("imdb_id")).alias("imdb_id"),
        F.when(good, F.col("tmdb_id")).alias("tmdb_id"), F.when(good, F.coalesce("other", "year")).alias("year"), (good & F.col("other").isNotNull()).alias("corrected"))


def choose_by_runtime(works: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """The one work whose runtime fits, if all its rivals are clearly outside. `actual(key, actual_s)`."""
    delta, listed = F.abs(F.col("actual_s") - F.col("runtime_s")), F.col("runtime_s")
    near, gray = F.greatest(F.lit(60.0), F.least(F.lit(180.0), listed * 0.02)), F.greatest(F.lit(600.0), listed * 0.10)
    fits = delta <= near
    agg = works.join(actual, key).groupBy(key).agg(
        F.first("actual_s").alias("actual_s"), F.count(F.lit(1)).alias("works"), F.count_if(listed.isNull() | (listed <= 0)).alias("unknown"),
        F.count_if(fits).alias("matches"), F.count_if(~fits & (delta <= gray)).alias("close"), F.min(F.when(fits, F.col("work_id"))).alias("winner"))
    reason = (
        F.when(F.col("actual_s").isNull() | (F.col("actual_s") <= 0), "no_duration").when(F.col("works") < 2, "single_work")
        .when(F.col("unknown") > 0, "unknown_rival_runtime").when(F.col("matches") != 1, "no_unique_match").when(F.col("close") > 0, "rival_close").otherwise(""))
    return agg.select(key, "works", "matches", reason.alias("reason"), F.when(reason == "", F.col("winner")).alias("work_id"))


def rival_ids(named: DataFrame, key: str = "identity_id") -> DataFrame:
    """(key, rival): do the exactly named rows `named(key, c_imdb, c_tmdb)` bring different ids? Rows that are alike may be given once."""
    rivals = named.groupBy(key).agg(*[
        (F.min(F.nullif(c, F.lit(""))) != F.max(F.nullif(c, F.lit("")))).alias(f"rival_{c}") for c in ("c_imdb", "c_tmdb")])
    return rivals.select(key, (F.coalesce("rival_c_imdb", F.lit(False)) | F.coalesce("rival_c_tmdb", F.lit(False))).alias("rival"))


def admission(rows: DataFrame, key: str = "identity_id") -> DataFrame:
    """Auto, pending or filtered per candidate of a work, as `state` and `reason` beside the columns given.

    `rows(identity_id, file_id, exact, prefix, blank, hash_match, c_imdb, c_tmdb, i_imdb, i_tmdb, episodic)`.
    Rival ids among the exactly named rows make their title match pending; a column `rival` of the work (`rival_ids`) is
    taken as it is, so that pairs need not be shuffled for it.
    """
    strong, differ = id_match([(F.col("c_imdb"), F.col("i_imdb")), (F.col("c_tmdb"), F.col("i_tmdb"))])
    if "rival" not in rows.columns:
        rows = rows.join(rival_ids(rows.filter("exact"), key), key, "left")
    rival = F.coalesce("rival", F.lit(False))
    state = (
        F.when(differ | F.col("episodic"), "filtered").when(F.col("hash_match") | strong, "auto")
        .when(F.col("exact"), F.when(rival, "pending").otherwise("auto")).when(F.col("blank") | F.col("prefix"), "pending").otherwise("filtered"))
    reason = (
        F.when(differ, "id_conflict").when(F.col("episodic"), "episode").when(F.col("hash_match"), "hash").when(strong, "ids")
        .when(F.col("exact"), F.when(rival, "rival_ids").otherwise("title_year")).when(F.col("blank") | F.col("prefix"), "incomplete").otherwise("no_evidence"))
    return rows.withColumns({"state": state, "reason": reason})


def screening_facts(pairs: DataFrame, keys) -> DataFrame:
    """What speaks against a candidate whatever its admission, as `repeated`, `role` and `conflict`.

    `pairs(keys, file_id, release, own_name, title, year, feature_year, duplicate_key)`, with works that see the same
    candidates under the same name as one key. The first candidate of a duplicate key stays; it is found by aggregation, not
    by ordering the group.
    """
    first = pairs.filter("duplicate_key is not null").groupBy(*keys, "duplicate_key").agg(F.min("file_id").alias("first_id"))
    r = F.col("release")
    release = F.coalesce(*[F.nullif(c, F.lit("")) for c in (
        tt.source_conflict(F.col("own_name"), r, F.array("title")), tt.edition_conflict(F.col("own_name"), r), tt.recut_conflict(F.col("own_name"), r, F.col("title")),
        tt.year_conflict(F.col("year"), r, F.col("feature_year")), tt.language_label_conflict(r))])
    # many candidates are called alike, so rules on names are applied to different names
    texts = ["title", "year", "own_name", "release", "feature_year"]
    told = pairs.select(*texts).distinct().select(*[F.col(c).alias(f"_{c}") for c in texts], subtitle_role(r, titles=F.array("title")).alias("role"), release.alias("conflict"))
    same = F.lit(True)
    for c in texts:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    marked = pairs.join(first.hint("merge"), [*keys, "duplicate_key"], "left").join(told.hint("merge"), same, "left")
    return marked.withColumn("repeated", F.coalesce(F.col("first_id") != F.col("file_id"), F.lit(False))).drop("first_id", *[f"_{c}" for c in texts])


def screen(pairs: DataFrame) -> DataFrame:
    """First reason against a candidate: duplicate, purpose, identity (or pending, if it may still turn out), release; empty
    means queued. `pairs(identity_id, file_id, provider, admission, repeated, role, conflict)` from `screening_facts`."""
    reason = (
        F.when(F.col("repeated"), "duplicate").when(~F.col("role").isin("main", "sdh"), "role")
        .when(F.col("admission") == "pending", "pending").when(F.col("admission") != "auto", "identity").when(F.col("conflict").isNotNull(), "release").otherwise(""))
    return pairs.withColumns({"reason": reason, "detail": F.when(reason == "release", F.col("conflict")).otherwise("")})


def prioritise(pairs: DataFrame, key: str | list[str] = "identity_id", slice_width: int = 10_000) -> DataFrame:
    """Search order of a work's candidates: match signals, then one turn per author, then provider order.

    `pairs(identity_id, seq, author, own_name, release, hash_match)`. Turns are counted per author
    within equal signals in slices of the provider order.
    """
    from cuemill.operators.ordered import Ordered

    stem = lambda c: F.regexp_replace(c, r"(?i)\.(?:mkv|mp4|avi|m2ts|srt|ass|ssa|sub|zip|txt)$", "")
    words = lambda c: F.array_join(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ")
    own, rel = F.col("own_name"), F.col("release")
    eds, src, grp = tt.editions(own), tt.source_family(tt.release_tags(own)), tt.release_group(own)
    signals = (
        F.when(F.col("hash_match"), 16).otherwise(0) + F.when(words(own) == words(stem(rel)), 8).otherwise(0)
        + F.when((F.size(eds) > 0) & (eds == tt.editions(rel)), 4).otherwise(0)
        + F.when((src != "") & (src == tt.source_family(tt.release_tags(rel))), 2).otherwise(0) + F.when((grp != "") & (grp == tt.release_group(rel)), 1).otherwise(0))
    author = F.lower(F.trim(F.coalesce("author", F.lit(""))))
    known = ~author.isin("", "anonymous", "unknown", "os-auto", "opensubtitles", "subdl", "n/a")
    keys = [key] if isinstance(key, str) else list(key)
    rows = pairs.select(*keys, "seq", "author", signals.alias("signals"), F.when(known, author).otherwise(F.lit("")).alias("_author"))
    counted = Ordered(rows, [*keys, "signals", "_author"], "seq", slice_width).row_number("_turn").result()
    turn = F.when(F.col("_author") == "", 0).otherwise(F.col("_turn") - 1)
    # Place inside a work: its tiers are few, so counts per (tier, turn) replace one long sort.
    placed = counted.withColumn("turn", turn)
    blocks = placed.groupBy(*keys, "signals", "turn").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys).orderBy(F.col("signals").desc(), "turn").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).drop("n")
    inside = Ordered(placed, [*keys, "signals", "turn"], "seq", slice_width).row_number("_inside").result()
    return inside.join(starts.hint("merge"), [*keys, "signals", "turn"]).select(
        *keys, "seq", "signals", F.col("turn").cast("long").alias("turn"), (F.col("before") + F.col("_inside")).alias("place"))


def provider_quota(rows: DataFrame, by: str, order: str, tie: str, share: float = 0.5, slice_width: int = 1) -> DataFrame:
    """The first `share` of every provider's rows by `order` and `tie`, one at least, and whether any were left out.

    Few providers may hold all rows, so places are numbered in slices of the integer column `order` and `slice_width`, and
    inside those in slices of the integer column `tie` of 65,536; the counts of the slices before are added.
    """
    cut = rows.withColumns({"_outer": F.floor(F.col(order) / slice_width), "_inner": F.floor(F.col(tie) / 65_536)})
    sizes = cut.groupBy(by, "_outer", order, "_inner").agg(F.count(F.lit(1)).alias("_n"))
    # a row for each slice of each provider
    before = Window.partitionBy(by).orderBy("_outer", order, "_inner").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(by, "_outer", order, "_inner", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(by)).alias("total"))
    quota = F.greatest(F.lit(1), F.floor(F.col("total") * share))
    # slices that begin beyond the quota hold none of it and are not ordered
    needed = starts.filter(F.col("_before") < quota)
    inside = F.row_number().over(Window.partitionBy(by, "_outer", order, "_inner").orderBy(tie))
    placed = cut.join(needed, [by, "_outer", order, "_inner"]).withColumn("place", (F.col("_before") + inside).cast("int"))
    return placed.filter(F.col("place") <= quota).withColumn("truncated", F.col("total") > quota).drop("_outer", "_inner", "_before")
