"""Clause operators: type, risk, importance, party, wording, quoted values, ranking and briefing groups.

Input rows are clauses ``(doc_id, para_no, pos, clause, full_text)``. Rules are
literal expressions over the row, so classifying never joins. Ranking and
grouping work per document; a document's clauses come from one text cell, which
bounds every group.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import (bind, contains_any, count_matches, find_all, first_of, literal_word, lookup,
                                 letter_first, materialize, round_like_ieee, squeeze, strip)

CLAUSE = "clause"
ORDER = ["para_no", "pos"]


# --- classification ---------------------------------------------------------------

PREFIX_CHARS = 5


def _sorted_rules(rules):
    """Keyword patterns by the cheapest exact test: whole word, word prefix, or the regex itself."""
    whole: dict[str, list] = {}
    prefix: dict[str, list] = {}
    regex = []
    for t, (_, _, _, patterns) in enumerate(rules):
        for p, pattern in enumerate(patterns):
            if m := re.fullmatch(r"\\b([a-z]+)\\b", pattern):
                whole.setdefault(m.group(1), []).append((t, p))
            elif (m := re.fullmatch(r"\\b([a-z]+)", pattern)) and len(m.group(1)) >= PREFIX_CHARS:
                prefix.setdefault(m.group(1)[:PREFIX_CHARS], []).append((t, p, m.group(1)))
            else:
                regex.append((t, p, pattern))
    return whole, prefix, regex


def starts_of(words) -> str:
    """Pattern of any of ``words`` (letters only), each common start once."""
    tails: dict[str, set] = {}
    for w in words:
        tails.setdefault(w[0], set()).add(w[1:])
    each = [a + ("" if "" in rest else starts_of(rest)) for a, rest in sorted(tails.items())]
    return each[0] if len(each) == 1 else "(?:" + "|".join(each) + ")"


#: Hits are numbers: the type's place in the rules times this, plus the pattern's.
_TYPE_STEP = 1000


def with_type_scores(df: DataFrame, text: Column, rules=fixed.CLAUSE_TYPES) -> DataFrame:
    """Adds ``_best``, struct<score, prefer, type> of the best clause type, null without any match.

    Words that start like a single word or word prefix of the rules are taken from the
    text in one pass and told apart by hashing; only multi-word patterns run as regexes, and only on texts
    holding their longest word. Each match is a (type, pattern) hit; a type's score
    adds count x weight pattern by pattern. What needs no array function is a column of its own, so it runs compiled.
    """
    whole, prefix, regex = _sorted_rules(rules)
    hit = lambda t, p: F.lit(t * _TYPE_STEP + p)
    none = F.array().cast("array<int>")
    listed = rf"(?<![a-z\p{{L}}\p{{N}}_]){starts_of([*whole, *prefix])}[\p{{L}}\p{{N}}_]*"
    weights = F.array(*[F.lit(float(r[1])) for r in rules])
    whole_hits = F.create_map(*[x for w, tps in whole.items() for x in (F.lit(w), F.array(*[hit(t, p) for t, p in tps]))])
    prefix_hits = F.create_map(*[x for k, tps in prefix.items() for x in (F.lit(k), F.array(*[
        F.struct(hit(t, p).alias("h"), F.lit(full).alias("full")) for t, p, full in tps]))])
    low, hits = F.col("_low"), F.col("_hits")

    def by_word(w: Column) -> Column:
        stems = F.filter(F.try_element_at(prefix_hits, F.left(w, F.lit(PREFIX_CHARS))), lambda x: w.startswith(x["full"]))
        return F.concat(F.coalesce(F.try_element_at(whole_hits, w), none),
                        F.coalesce(F.transform(stems, lambda x: x["h"]), none))

    def by_regex(t: int, p: int, pattern: str) -> Column:
        found = F.array_repeat(hit(t, p), count_matches(low, letter_first(pattern)))
        hint = literal_word(pattern)
        return F.when(low.contains(hint), found).otherwise(none) if hint else found

    def of_type(t: Column) -> Column:
        mine = F.filter(hits, lambda h: F.floor(h / _TYPE_STEP) == t)
        total = bind(mine, lambda ms: F.aggregate(
            F.array_sort(F.array_distinct(ms)), F.lit(0.0),
            lambda acc, h: acc + F.size(F.filter(ms, lambda m: m == h)) * F.get(weights, t.cast("int"))))
        return F.struct(total.alias("score"), (-t).alias("prefer"), t.cast("int").alias("type"))

    known = F.filter(find_all(low, listed), lambda w: w.isin(*whole) | F.left(w, F.lit(PREFIX_CHARS)).isin(*prefix))
    df = df.withColumn("_low", F.lower(text)).withColumn("_words", F.flatten(F.transform(known, by_word)))
    df = df.withColumn("_hits", F.concat("_words", *[by_regex(*r) for r in regex]))
    best = F.array_max(F.transform(F.array_distinct(F.transform(hits, lambda h: F.floor(h / _TYPE_STEP))), of_type))
    return materialize(df, {"_best": F.when(F.size(hits) > 0, best)}).drop("_low", "_words", "_hits")


def score_types(clauses: DataFrame, rules=fixed.CLAUSE_TYPES, text: str = CLAUSE) -> DataFrame:
    """Adds clause_type, confidence and the type's default risk; the highest score wins, first listed on ties."""
    df = with_type_scores(clauses, F.col(text), rules)
    of_best = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("_best.type"))
    score = F.coalesce(F.col("_best.score"), F.lit(0.0))
    return materialize(df, {
        "clause_type": F.coalesce(of_best([r[0] for r in rules]), F.lit(fixed.FALLBACK_TYPE)),
        "confidence": round_like_ieee(F.least(F.lit(0.98), F.lit(0.5) + score * 0.15)),
        "default_risk": F.coalesce(of_best([r[2] for r in rules]), F.lit("low")),
    }).drop("_best")


def risk_level(clauses: DataFrame, text: str = CLAUSE) -> DataFrame:
    """Default risk of the type; low becomes medium when the clause holds a duty word and a money word."""
    low = F.lower(F.col(text))
    strong = low.rlike(fixed.DUTY_WORDS) & low.rlike(fixed.MONEY_WORDS)
    return clauses.withColumn("risk_level", F.when((F.col("default_risk") == "low") & strong, "medium")
                              .otherwise(F.col("default_risk"))).drop("default_risk")


def drop_weak(clauses: DataFrame, min_conf: float = 0.55) -> DataFrame:
    return clauses.filter(F.col("confidence") >= min_conf)


def importance(clauses: DataFrame, rules=fixed.CLAUSE_TYPES) -> DataFrame:
    weight = F.coalesce(lookup({name: float(w) for name, w, _, _ in rules}, F.col("clause_type")), F.lit(0.5))
    scored = materialize(clauses, {
        "importance_score": round_like_ieee(F.least(F.lit(1.0), F.col("confidence") * weight + 0.1))})
    score = F.col("importance_score")
    return scored.withColumn("importance_label", F.when(score >= 0.8, "Critical").when(
        score >= 0.6, "Important").otherwise("Standard"))


def responsible_party(clauses: DataFrame, parties: DataFrame | None = None, text: str = CLAUSE) -> DataFrame:
    """Who must act: roles bound to a duty word on one line, else the document's known parties, else any role word.

    ``parties`` has one row per document: (doc_id, parties map<role, name>); clauses may carry that column themselves.
    """
    df = clauses.join(parties.hint("merge"), "doc_id", "left") if parties is not None else clauses
    low, none = F.col("_low"), F.array(F.lit(None).cast("string"))
    told = lambda values: F.array_except(F.array(*values), none)  # noqa: E731  distinct, in order

    def duty(role: str, subjects: str, duties: str) -> Column:
        pattern = rf"\b({subjects})\b[^\n]*\b({duties})\b"
        return F.when(contains_any(low, subjects.split("|")) & low.rlike(pattern), role)

    def by_name() -> Column:
        hits = F.filter(F.map_entries("parties"), lambda e: (
            ((F.length(e["value"]) > 0) & low.contains(F.lower(e["value"]))) | low.contains(F.lower(e["key"]))))
        return F.array_distinct(F.coalesce(F.transform(hits, lambda e: F.initcap(e["key"])), F.array().cast("array<string>")))

    # each a column of its own, so that all but the names runs compiled; what comes later is asked only where the former found none
    df = df.withColumn("_low", F.lower(F.col(text))).withColumn("_roles", told([duty(*rule) for rule in fixed.ROLE_DUTIES]))
    if "parties" in df.columns:
        df = df.withColumn("_roles", F.when(F.size("_roles") > 0, F.col("_roles")).otherwise(by_name()))
    df = df.withColumn("_institution", F.when(F.size("_roles") == 0, contains_any(low, fixed.INSTITUTION_TERMS)))
    by_word = told([F.when(low.contains(r) & (F.lit(r in fixed.INSTITUTION_EXEMPT_ROLES) | ~F.col("_institution")), r.title())
                    for r in fixed.LEGAL_ROLES])
    df = df.withColumn("_roles", F.when(F.size("_roles") > 0, F.col("_roles")).otherwise(by_word))
    party = F.when(F.size("_roles") > 1, "Both").when(F.size("_roles") == 1, F.get("_roles", F.lit(0))).otherwise("Unknown")
    return materialize(df, {"responsible_party": party}).drop("parties", "_low", "_roles", "_institution")


# --- values and wording ---------------------------------------------------------------

def _quoted(clauses: DataFrame, name: str, text: str, patterns: list[str], needs: list[list[str]], starts: list[str], n: int,
            min_chars: int) -> DataFrame:
    """Adds ``name``: distinct matches in order of pattern, then position; a pattern runs only where one of its ``needs`` occurs, and
    from the characters ``starts`` that its matches begin with."""
    none = F.array().cast("array<string>")
    df = clauses.withColumn("_low", F.lower(F.col(text)))
    df = df.withColumn("_every", F.concat(*[F.when(contains_any(F.col("_low"), words), find_all(F.col(text), f"(?iU)(?={start}){p}")).otherwise(none)
                                            for p, words, start in zip(patterns, needs, starts)]))
    kept = F.filter(F.transform("_every", lambda v: strip(v)), lambda v: F.length(v) >= min_chars)
    return materialize(df, {name: F.when(F.size("_every") > 0, F.slice(F.array_distinct(kept), 1, n)).otherwise(F.col("_every"))}).drop("_low", "_every")


def clause_amounts(clauses: DataFrame, n: int = 5, text: str = CLAUSE) -> DataFrame:
    """Adds the first ``n`` amounts quoted in the clause."""
    needs = [["rs", "inr", "₹"], [","], ["%"]]
    return _quoted(clauses, "financial_values", text, fixed.AMOUNT_PATTERNS, needs, ["[ri₹]", r"\d", r"\d"], n, 2)


def clause_deadlines(clauses: DataFrame, n: int = 4, text: str = CLAUSE) -> DataFrame:
    """Adds the first ``n`` deadlines quoted in the clause."""
    needs = [["within"], ["day", "month", "year", "week"], ["before", "by"], ["commencement", "expiry", "completion"]]
    return _quoted(clauses, "deadlines", text, fixed.DEADLINE_PATTERNS, needs, ["w", r"\d", "[bo]", "[ce]"], n, 1)


def clause_title(clauses: DataFrame, text: str = CLAUSE) -> DataFrame:
    low, kind = F.lower(F.col(text)), F.col("clause_type")
    special = first_of([((kind == t) & low.contains(word), title) for t, word, title in fixed.TITLE_RULES])
    base = F.coalesce(lookup(fixed.BASE_TITLES, kind), F.lit(fixed.DEFAULT_TITLE))
    return clauses.withColumn("title", F.coalesce(special, base))


def plain_summary(clauses: DataFrame) -> DataFrame:
    """Fixed wording of the type with party, first amount and first deadline filled in."""
    def quoted(lead: str, values: str) -> Column:
        return F.coalesce(F.concat(F.lit(lead), F.get(F.col(values), F.lit(0))), F.lit(""))

    other = F.concat(F.lit("This provision governs "), F.replace(F.col("clause_type"), F.lit("_"), F.lit(" ")), F.lit(
        " obligations under the agreement. {p} should review this clause carefully to understand their rights, "
        "responsibilities, and potential exposure."))
    party = F.coalesce(F.nullif(F.col("responsible_party"), F.lit("")), F.lit("A party"))
    text = F.coalesce(lookup(fixed.PLAIN_SUMMARIES, F.col("clause_type")), other)
    for mark, value in (("{p}", party), ("{f}", quoted(" of ", "financial_values")), ("{d}", quoted(" by ", "deadlines"))):
        text = F.replace(text, F.lit(mark), value)
    return clauses.withColumn("summary", text)


def legal_impact(clauses: DataFrame) -> DataFrame:
    return clauses.withColumn("legal_impact", F.coalesce(lookup(fixed.LEGAL_IMPACTS, F.col("clause_type")),
                                                         F.lit(fixed.DEFAULT_IMPACT)))


def describe_clauses(clauses: DataFrame, parties: DataFrame | None = None, rules=fixed.CLAUSE_TYPES,
                     text: str = CLAUSE, only: list[str] | None = None) -> DataFrame:
    """All per-clause columns, or of the costly ones those named in ``only`` and what they are made from; weak matches are dropped
    before the remaining work."""
    df = importance(risk_level(drop_weak(score_types(clauses, rules, text)), text), rules)
    needed = {"responsible_party", "financial_values", "deadlines", "summary"} if only is None else {*only}
    if needed & {"responsible_party", "summary"}:
        df = responsible_party(df, parties, text)
    if needed & {"financial_values", "summary"}:
        df = clause_amounts(df, text=text)
    if needed & {"deadlines", "summary"}:
        df = clause_deadlines(df, text=text)
    df = clause_title(df, text)
    return legal_impact(plain_summary(df) if "summary" in needed else df)


# --- dedup, ranking ---------------------------------------------------------------------

def dedup_clauses(clauses: DataFrame, full_text: str = "full_text") -> DataFrame:
    """First clause per document, type and opening 200 characters of its paragraph."""
    df = materialize(clauses, {"_key": F.left(F.lower(squeeze(F.col(full_text))), F.lit(200))})
    first = Window.partitionBy("doc_id", "clause_type", "_key").orderBy(*ORDER)
    return df.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "_key")


def _critical_first() -> Column:
    return F.when(F.col("clause_type").isin(*fixed.CRITICAL_TYPES), 0).otherwise(1)


def _label_rank(label: Column) -> Column:
    return F.when(label == "Critical", 0).when(label == "Important", 1).when(label == "Standard", 2).otherwise(3)


def rank_clauses(clauses: DataFrame) -> DataFrame:
    """``rank`` from 1 per document: critical types, then label, then score, then text order."""
    w = Window.partitionBy("doc_id").orderBy(_critical_first(), _label_rank(F.col("importance_label")),
                                             F.col("importance_score").desc(), *ORDER)
    return clauses.withColumn("rank", F.row_number().over(w))


def top_clauses(clauses: DataFrame, n: int = 8) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(_critical_first(), F.col("importance_score").desc(), *ORDER)
    return clauses.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


# --- briefing groups ----------------------------------------------------------------------

def with_category(clauses: DataFrame) -> DataFrame:
    return clauses.withColumn("category", F.coalesce(lookup(fixed.CATEGORY_OF_TYPE, F.col("clause_type")),
                                                     F.lit(fixed.FALLBACK_CATEGORY)))


def _members() -> Column:
    """A group's clauses in rank order; bounded by the clauses of one document."""
    fields = ["rank", "importance_score", "importance_label", "risk_level", "summary", "financial_values", "deadlines",
              "legal_impact", "responsible_party"]
    return F.array_sort(F.collect_list(F.struct(*fields)))


def _by_score(members: Column) -> Column:
    keyed = F.transform(members, lambda m: F.struct((-m["importance_score"]).alias("s"), m["rank"].alias("r"), m.alias("m")))
    return F.transform(F.array_sort(keyed), lambda k: k["m"])


def _best_three(members: Column) -> Column:
    return F.slice(_by_score(members), 1, 3)


def _merged_summary(members: Column) -> Column:
    """Summary of the best clause, plus one differing summary of the next two."""
    def merge(texts: Column) -> Column:
        lead = F.get(texts, F.lit(0))
        more = F.filter(F.slice(texts, 2, 2), lambda s: (F.length(s) > 0) & (s != lead) & ~F.startswith(
            lead, F.left(s, F.lit(30))))
        return F.when(F.size(more) > 0, F.concat(F.rtrim(lead, F.lit(".")), F.lit(". "), F.rtrim(
            F.get(more, F.lit(0)), F.lit(".")), F.lit("."))).otherwise(lead)
    return bind(F.transform(_best_three(members), lambda m: strip(m["summary"])), merge)


def _highest(members: Column, field: str, ranking: dict[str, int]) -> Column:
    """Highest value of ``field`` by ``ranking``; unknown values count as the lowest."""
    low = min(ranking, key=ranking.get)
    names = {v: k for k, v in ranking.items()}
    best = F.array_max(F.transform(members, lambda m: F.coalesce(lookup(ranking, m[field]), F.lit(ranking[low]))))
    return lookup(names, best)


RISK_RANK = {"high": 2, "medium": 1, "low": 0}
LABEL_RANK = {"Critical": 2, "Important": 1, "Standard": 0}


def _group_columns(members: Column) -> dict[str, Column]:
    distinct = lambda field, n: F.slice(F.array_distinct(F.flatten(F.transform(members, lambda m: m[field]))), 1, n)
    parties = F.filter(F.transform(members, lambda m: m["responsible_party"]), lambda p: (F.length(p) > 0) & (p != "Unknown"))
    return {
        "risk_level": _highest(members, "risk_level", RISK_RANK),
        "financial_values": distinct("financial_values", 5),
        "deadlines": distinct("deadlines", 4),
        "key_risks": F.slice(F.array_distinct(F.filter(F.transform(members, lambda m: m["legal_impact"]),
                                                       lambda t: F.length(t) > 0)), 1, 3),
        "responsible_parties": F.array_sort(F.array_distinct(parties)),
        "source_count": F.size(members).cast("long"),
    }


def _labelled(groups: DataFrame) -> DataFrame:
    order = {c: i for i, (c, _, _) in enumerate(fixed.CATEGORIES)}
    return groups.withColumns({"label": lookup({c: l for c, l, _ in fixed.CATEGORIES}, F.col("category")),
                               "group_no": lookup(order, F.col("category"))}).drop("_m")


def insight_groups(ranked: DataFrame) -> DataFrame:
    """One row per document and category with merged values; plain obligations are left out."""
    df = with_category(ranked).filter(~F.col("clause_type").isin(*fixed.UNGROUPED_TYPES))
    groups = df.groupBy("doc_id", "category").agg(_members().alias("_m"))
    m = F.col("_m")
    return _labelled(groups.withColumns({"importance_label": _highest(m, "importance_label", LABEL_RANK),
                                         "summary": _merged_summary(m), **_group_columns(m)}))


def group_summary(ranked: DataFrame) -> DataFrame:
    return insight_groups(ranked).select("doc_id", "category", "summary")


def supplement_groups(ranked: DataFrame, min_groups: int = 5) -> DataFrame:
    """Extra groups for documents with fewer than ``min_groups``: categories not shown yet, from clauses whose
    paragraph is in no group."""
    shown = ~F.col("clause_type").isin(*fixed.UNGROUPED_TYPES)
    doc = Window.partitionBy("doc_id")
    df = with_category(ranked).withColumns({
        "_cats": F.collect_set(F.when(shown, F.col("category"))).over(doc),
        "_featured": F.max(shown).over(Window.partitionBy("doc_id", "full_text")),
    }).filter((F.size("_cats") < min_groups) & ~F.col("_featured") & ~F.array_contains("_cats", F.col("category")))
    by_priority = Window.partitionBy("doc_id", "category").orderBy(_critical_first(), F.col("importance_score").desc(), "rank")
    groups = df.withColumn("rank", F.row_number().over(by_priority)).groupBy("doc_id", "category").agg(_members().alias("_m"))
    m = F.col("_m")
    groups = groups.withColumn("_m", _by_score(m))
    return _labelled(groups.withColumns({"importance_label": F.get(m, F.lit(0))["importance_label"],
                                         "summary": F.get(m, F.lit(0))["summary"], **_group_columns(m)}))


def briefing(ranked: DataFrame, min_groups: int = 5) -> DataFrame:
    """``insight_groups`` plus ``supplement_groups``, from one reading of the clauses: a clause belongs to a group of either kind
    or to none, and both kinds are made inside the placement of the documents."""
    shown = ~F.col("clause_type").isin(*fixed.UNGROUPED_TYPES)
    doc = Window.partitionBy("doc_id")
    rows = with_category(ranked).withColumns({
        "_shown": shown, "_cats": F.collect_set(F.when(shown, F.col("category"))).over(doc),
        "_featured": F.max(shown).over(Window.partitionBy("doc_id", "full_text"))})
    more = (F.size("_cats") < min_groups) & ~F.col("_featured") & ~F.array_contains("_cats", F.col("category"))
    by_priority = Window.partitionBy("doc_id", "category", "_shown").orderBy(_critical_first(), F.col("importance_score").desc(), "rank")
    rows = rows.filter(F.col("_shown") | more).withColumn("_place", F.row_number().over(by_priority))
    rows = rows.withColumn("rank", F.when(F.col("_shown"), F.col("rank")).otherwise(F.col("_place")))
    groups = rows.groupBy("doc_id", "category", "_shown").agg(_members().alias("_m"))
    groups = groups.withColumn("_m", F.when(F.col("_shown"), F.col("_m")).otherwise(_by_score(F.col("_m"))))
    m, first = F.col("_m"), F.get("_m", F.lit(0))
    label = F.when(F.col("_shown"), _highest(m, "importance_label", LABEL_RANK)).otherwise(first["importance_label"])
    summary = F.when(F.col("_shown"), _merged_summary(m)).otherwise(first["summary"])
    return _labelled(groups.withColumns({"importance_label": label, "summary": summary, **_group_columns(m)}).drop("_shown"))


def group_keys(clauses: DataFrame) -> DataFrame:
    """(doc_id, category) of each group of a briefing, known from the clause types alone: dropping repeats leaves every type."""
    kept = clauses.filter(~F.col("clause_type").isin(*fixed.UNGROUPED_TYPES))
    return with_category(kept).select("doc_id", "category").distinct()


def category_counts(groups: DataFrame) -> DataFrame:
    """Groups per category, with an All row."""
    name = F.coalesce(lookup({c: short for c, _, short in fixed.CATEGORIES}, F.col("category")), F.col("category"))
    counts = groups.rollup("category").agg(F.count("*").alias("n"), F.grouping("category").alias("_all"))
    return counts.select(F.when(F.col("_all") == 1, "All").otherwise(name).alias("category"), "n")
