"""Best postings for many criteria sets, with the sets as a table.

Terms and place of a set are its wish; pay and age are compared with numbers. Equal wishes are matched once, and so are
equal contents of postings: the terms of all wishes form an inverted index, in which every distinct term is filed under its
rarest piece of three letters; contents are met by the pieces they contain, and what meets is confirmed by the whole term.

Contents with the same terms are of one kind. Of a kind, a posting that n others precede in pay, age and id is among the best
n of no set; the rest is compared with the sets in tiles of a block of sets and a block of postings, each of which passes on
its best rows alone. Where few sets and postings have terms in common, those pairs are joined first: a set is closed when
enough postings score above all that can be had without a term, and only the open ones go to the tiles.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.functions.core import clamp_score
from postmill.functions.terms import AI_TERMS, ai_flag, pm_flag, term_list, title_tokens
from postmill.operators.scoring import exclude_terms, mode, scoring_terms, target_days, target_salary, with_content_path, with_facts
from postmill.operators.settle import settle
from postmill.operators.skew import top_n_per_key
from postmill.params import CRITERIA_WEIGHTS, Criteria

GRAM = 3
POSTINGS_PER_TILE, SETS_PER_TILE = 50_000, 1_000
PER_JOINED = 100  # scores in a tile that cost as much as one joined row
_STRINGS = T.ArrayType(T.StringType())
_COMPILED = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("tokens", _STRINGS), T.StructField("keywords", _STRINGS), T.StructField("any_keyword", T.BooleanType()),
    T.StructField("include", _STRINGS), T.StructField("any_include", T.BooleanType()), T.StructField("exclude", _STRINGS),
    T.StructField("location", T.StringType()), T.StructField("salary", T.LongType()), T.StructField("days", T.IntegerType()),
])


@F.pandas_udf(_COMPILED)
def compiled(sets: pd.DataFrame) -> pd.DataFrame:
    """The terms and limits of criteria sets, read from their fields."""
    out = []
    for row in sets.to_dict("records"):
        given = {k: list(v) if isinstance(v, np.ndarray) else v for k, v in row.items() if isinstance(v, np.ndarray) or not pd.isna(v)}
        c = Criteria(**given)
        title = c.title.strip().lower()
        out.append((
            title, list(dict.fromkeys(title_tokens(title))), scoring_terms(c), mode(c.score_keyword_mode or c.keyword_mode) == "or",
            term_list(c.hard_include), mode(c.hard_include_mode) == "or", exclude_terms(c), c.location.strip().lower(), target_salary(c), target_days(c),
        ))
    return pd.DataFrame(out, columns=_COMPILED.fieldNames()).astype({"days": "Int32"})


def criteria_table(users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(user_id, set_) and the distinct criteria, numbered ``set_`` and compiled once each to the columns of ``_COMPILED``."""
    fields = [f.name for f in dataclasses.fields(Criteria) if f.name in users.columns]
    given = F.struct(*fields)
    asked = settle(users.select("user_id", F.sha2(F.to_json(given, {"ignoreNullFields": "false"}), 256).alias("key_"), given.alias("given")), "criteria-users")
    numbered = asked.groupBy("key_").agg(F.first("given").alias("given")).withColumn("set_", F.monotonically_increasing_id())
    # Written once, so the numbers stay.
    sets = settle(numbered.select("key_", "set_", compiled("given").alias("c")).select("key_", "set_", "c.*"), "criteria-sets")
    return asked.join(sets.select("key_", "set_"), "key_").select("user_id", "set_"), sets.drop("key_")


def _grams(c: Column) -> Column:
    """Distinct pieces of one, two and three letters."""
    return F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(1), F.lit(GRAM)),
        lambda n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n))).otherwise(F.array().cast("array<string>")),
    )))


WISH = ["title", "tokens", "keywords", "any_keyword", "include", "any_include", "exclude", "location"]


def _needs(wishes: DataFrame) -> DataFrame:
    """One row per term of a wish: wish_, kind, field (title, text or place), term, alike (synonyms count)."""
    def each(kind: str, terms: Column, field: str, alike: bool) -> Column:
        return F.transform(terms, lambda t: F.struct(F.lit(kind).alias("kind"), F.lit(field).alias("field"), t.alias("term"), F.lit(alike).alias("alike")))

    given = lambda c: F.filter(F.array(c), lambda t: t != "")
    rows = F.concat(
        each("whole", given("title"), "title", True), each("token", F.col("tokens"), "title", True), each("keyword", F.col("keywords"), "text", True),
        each("include", F.col("include"), "text", False), each("exclude", F.col("exclude"), "text", False), each("place", given("location"), "place", False),
    )
    return wishes.select("wish_", F.inline(rows))


def _matches(facts: DataFrame, needs: DataFrame) -> DataFrame:
    """id, field, term, alike of every posting that has a term."""
    synonym = F.when(F.col("alike") & F.col("term").isin(AI_TERMS), "ai").when(F.col("alike") & (F.col("term") == "product manager"), "pm")
    terms = needs.select("field", "term", "alike").distinct().withColumn("synonym", synonym)
    plain = terms.filter("synonym IS NULL")
    size = F.least(F.length("term"), F.lit(GRAM))
    pieces = plain.select("field", "term", "alike", F.explode(F.filter(_grams(F.col("term")), lambda g: F.length(g) == size)).alias("gram"))
    wanted = pieces.select("field", "gram").distinct()
    held = facts.select("id", F.explode(F.array(F.struct(F.lit("title").alias("field"), F.col("f_title").alias("t")), F.struct(F.lit("text").alias("field"), F.col("f_text").alias("t")))).alias("x"))
    held = held.select("id", "x.field", F.explode(_grams(F.col("x.t"))).alias("gram")).join(wanted, ["field", "gram"], "left_semi")
    held = settle(held, "criteria-pieces")
    often = held.groupBy("field", "gram").agg(F.count("*").alias("n"))
    filed = pieces.join(often, ["field", "gram"]).groupBy("field", "term", "alike").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count("*").alias("found"))
    # A term with a piece that no posting has is in none.
    complete = pieces.groupBy("field", "term", "alike").agg(F.count("*").alias("all")).join(filed, ["field", "term", "alike"]).filter("found = all")
    near = held.join(complete.select("field", "term", "alike", "gram"), ["field", "gram"]).select("id", "field", "term", "alike")
    text = F.when(F.col("field") == "title", F.col("f_title")).otherwise(F.col("f_text"))
    found = near.join(facts.select("id", "f_title", "f_text"), "id").filter(F.contains(text, F.col("term"))).select("id", "field", "term", "alike")
    flags = facts.select("id", F.explode(F.array_compact(F.array(*[
        F.when(flag(F.col(c)), F.struct(F.lit(field).alias("field"), F.lit(name).alias("synonym")))
        for field, c in (("title", "f_title"), ("text", "f_text")) for name, flag in (("ai", ai_flag), ("pm", pm_flag))
    ]))).alias("x")).select("id", "x.*")
    alike = flags.join(terms.filter("synonym IS NOT NULL"), ["field", "synonym"]).select("id", "field", "term", "alike")
    return found.unionByName(alike)


def _score(total: Column, title: Column, keywords: Column, place: Column, pay: Column, age: Column, blocked: Column, title_missed: Column) -> Column:
    raw = F.when(total > 0, clamp_score((F.lit(0.0) + title + keywords + place + pay + age) / total * 100)).otherwise(0)
    return F.when(blocked, 0).when(title_missed, F.least(raw, F.lit(25))).otherwise(raw).cast("int")


def _total(w: dict = CRITERIA_WEIGHTS) -> Column:
    """Weight of all criteria that a set has."""
    part = lambda ok, n: F.when(ok, n).otherwise(0)
    return (
        part(F.col("title") != "", w["title"]) + part(F.size("keywords") > 0, w["keywords"]) + part(F.col("location") != "", w["location"])
        + part(F.col("salary") > 0, w["salary"]) + part(F.col("days").isNotNull(), w["freshness"])
    )


def _kinds(contents: DataFrame, needs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Contents by the terms they have: (content, kind_), (kind_, term_) and the numbered terms. No wish tells contents of one kind apart."""
    terms = settle(needs.select("field", "term", "alike").distinct().withColumn("term_", F.monotonically_increasing_id()), "criteria-terms")
    text = _matches(contents.withColumnRenamed("content", "id"), needs.filter("field <> 'place'")).withColumnRenamed("id", "content")
    places = terms.filter("field = 'place'")
    own = contents.select("f_location").filter("f_location <> ''").distinct()
    near = own.join(places, F.contains("f_location", F.col("term")) | F.contains("term", F.col("f_location"))).select("f_location", "term_")
    met = text.join(terms, ["field", "term", "alike"]).select("content", "term_").unionByName(contents.join(near, "f_location").select("content", "term_"))
    marks = met.groupBy("content").agg(F.sort_array(F.collect_list("term_")).alias("marks"))
    marked = settle(contents.select("content").join(marks, "content", "left").withColumn("marks", F.coalesce("marks", F.array().cast("array<bigint>"))), "criteria-marks")
    kinds = settle(marked.select("marks").distinct().withColumn("kind_", F.monotonically_increasing_id()), "criteria-kinds")
    return marked.join(kinds, "marks").select("content", "kind_"), kinds.select("kind_", F.explode("marks").alias("term_")), terms


def _in_front(posts: DataFrame, n: int) -> DataFrame:
    """Postings (kind_, id, pay, age) without those that ``n`` of their kind precede: pay no less, age no more, id smaller.

    Those score at least as high for every set, and win ties. Decided in tiles of any postings, then once more by kind.
    """
    def front(here: pd.DataFrame) -> pd.DataFrame:
        keep = []
        for _, rows in here.sort_values("id", ignore_index=True).groupby("kind_", sort=False):
            pay, age = rows["pay"].fillna(-np.inf).to_numpy(float), rows["age"].fillna(np.inf).to_numpy(float)
            held_pay, held_age, size, at = np.empty(len(rows)), np.empty(len(rows)), 0, rows.index.to_numpy()
            for i in range(len(rows)):
                if size < n or np.count_nonzero((held_pay[:size] >= pay[i]) & (held_age[:size] <= age[i])) < n:
                    held_pay[size], held_age[size], size = pay[i], age[i], size + 1
                    keep.append(at[i])
        return here.sort_values("id", ignore_index=True).iloc[sorted(keep)]

    for key in ("id", "kind_"):
        blocks = max(1, -(-posts.count() // POSTINGS_PER_TILE))
        tiled = posts.groupBy(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("tile"))
        posts = settle(tiled.applyInPandas(lambda t: front(t), "kind_ long, id string, pay double, age double"), "criteria-front")
    return posts


def _score(total: Column, points: Column, pay: Column, age: Column, blocked: Column, title_missed: Column) -> Column:
    raw = F.when(total > 0, clamp_score((points + pay + age) / total * 100)).otherwise(0)
    return F.when(blocked, 0).when(title_missed, F.least(raw, F.lit(25))).otherwise(raw).cast("int")


def _total(w: dict = CRITERIA_WEIGHTS) -> Column:
    """Weight of all criteria that a set has."""
    part = lambda ok, n: F.when(ok, n).otherwise(0)
    return (
        part(F.col("title") != "", w["title"]) + part(F.size("keywords") > 0, w["keywords"]) + part(F.col("location") != "", w["location"])
        + part(F.col("salary") > 0, w["salary"]) + part(F.col("days").isNotNull(), w["freshness"])
    )


def _pairs(wishes: DataFrame, needs: DataFrame, terms: DataFrame, held: DataFrame) -> DataFrame:
    """wish_, kind_, points (title, keywords, place), blocked, missed (the title) of every pair with a term in common."""
    w = CRITERIA_WEIGHTS
    hit = needs.join(terms, ["field", "term", "alike"]).select("wish_", "kind", "term_").join(held, "term_")
    n = lambda kind: F.count_if(F.col("kind") == kind).alias(f"n_{kind}")
    j = hit.groupBy("wish_", "kind_").agg(*[n(k) for k in ("whole", "token", "keyword", "include", "exclude", "place")]).join(wishes, "wish_")
    title_hit = (F.col("n_whole") > 0) | ((F.size("tokens") > 0) & (F.col("n_token") >= F.size("tokens")))
    size, found = F.size("keywords"), F.col("n_keyword")
    partly = F.lit(float(w["keywords"])) * (found / size) * 0.5
    keywords = F.when(size == 0, 0.0).when(F.col("any_keyword"), F.when(found > 0, float(w["keywords"])).otherwise(0.0)).when(found >= size, float(w["keywords"])).otherwise(partly)
    short = F.when(F.col("any_include"), F.col("n_include") == 0).otherwise(F.col("n_include") < F.size("include"))
    blocked = (F.col("n_exclude") > 0) | ((F.size("include") > 0) & short)
    has_title = F.col("title") != ""
    points = F.lit(0.0) + F.when(has_title & title_hit, w["title"]).otherwise(0) + keywords + F.when(F.col("n_place") > 0, w["location"]).otherwise(0)
    return j.select("wish_", "kind_", points.alias("points"), blocked.alias("blocked"), (has_title & ~title_hit).alias("missed"))


def _scored_pairs(posts: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """set_, id, score of every set and posting with a term in common."""
    w = CRITERIA_WEIGHTS
    j = pairs.join(sets.select("wish_", "set_", "salary", "days", _total().alias("total")), "wish_").join(posts, "kind_")
    pay = F.when((F.col("salary") > 0) & (F.col("pay") >= F.col("salary")), w["salary"]).otherwise(0)
    return j.select("set_", "id", _score(F.col("total"), F.col("points"), pay, F.when(F.col("age") <= F.col("days"), w["freshness"]).otherwise(0), F.col("blocked"), F.col("missed")).alias("score"))


def _without_terms() -> Column:
    """The most a set can give a posting that has none of its terms."""
    w = CRITERIA_WEIGHTS
    return _score(
        _total(), F.lit(0.0), F.when(F.col("salary") > 0, w["salary"]).otherwise(0),
        F.when(F.col("days").isNotNull(), w["freshness"]).otherwise(0), F.size("include") > 0, F.col("title") != "",
    )


def _tiles(posts: DataFrame, sets: DataFrame, pairs: DataFrame, n: int, postings: int, n_sets: int) -> DataFrame:
    """set_, id, score: the best ``n`` of each set in each block of postings, whether they share terms or not.

    Sets of one wish share a block, unless they are many; postings of one kind do as well.
    """
    w = CRITERIA_WEIGHTS
    p_blocks, s_blocks = max(1, -(-postings // POSTINGS_PER_TILE)), max(1, -(-n_sets // SETS_PER_TILE))
    part = F.pmod(F.xxhash64("set_"), F.ceil(F.col("of_wish") / SETS_PER_TILE))
    alone = F.col("of_wish") >= SETS_PER_TILE
    s = F.when(alone, F.xxhash64("wish_", part)).otherwise(F.pmod(F.xxhash64("wish_"), F.lit(s_blocks))).alias("s")
    dealt = sets.join(sets.groupBy("wish_").agg(F.count("*").alias("of_wish")), "wish_").select("*", s)
    placed = posts.withColumn("p", F.pmod(F.xxhash64("id"), F.lit(p_blocks)).cast("int"))
    none = lambda t: F.lit(None).cast(t)
    rows = placed.crossJoin(F.broadcast(dealt.select("s").distinct())).select(
        "p", "s", "id", "kind_", none("long").alias("set_"), none("long").alias("wish_"), "pay", "age", none("int").alias("total"), none("boolean").alias("titled"), none("boolean").alias("blocked"))
    asked = dealt.select(F.explode(F.sequence(F.lit(0), F.lit(p_blocks - 1))).alias("p"), "s", none("string").alias("id"), none("long").alias("kind_"), "set_", "wish_", F.col("salary").cast("double").alias("pay"),
                         F.col("days").cast("double").alias("age"), _total().alias("total"), (F.col("title") != "").alias("titled"), (F.size("include") > 0).alias("blocked"))
    of_wish, of_kind = dealt.select("wish_", F.col("s").alias("s_")).distinct(), placed.select("kind_", F.col("p").alias("p_")).distinct()
    known = pairs.join(of_wish, "wish_").join(of_kind, "kind_")

    def best(here: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        posts = here[here["id"].notna()].sort_values("id", ignore_index=True)
        size = len(posts)
        kinds, kind = np.unique(posts["kind_"].to_numpy(np.int64), return_inverse=True)
        pay, age = posts["pay"].to_numpy(float), posts["age"].to_numpy(float)
        by_wish = dict(list(met.groupby("wish_")))
        out = []
        for wish, of_wish in here[here["id"].isna()].groupby("wish_"):
            first = of_wish.iloc[0]
            points, blocked, missed = np.zeros(len(kinds)), np.full(len(kinds), bool(first["blocked"])), np.full(len(kinds), bool(first["titled"]))
            if wish in by_wish:
                m = by_wish[wish]
                at = np.searchsorted(kinds, m["kind_"].to_numpy(np.int64))
                points[at], blocked[at], missed[at] = m["points"], m["blocked"], m["missed"]
            base, most = points[kind], np.where(blocked, 0, np.where(missed, 25, 100))[kind]
            for c in of_wish.itertuples(index=False):
                x = base
                if c.pay > 0:
                    x = x + np.where(pay >= c.pay, w["salary"], 0)  # unknown pay compares false
                if c.age == c.age:
                    x = x + np.where(age <= c.age, w["freshness"], 0)
                x = np.floor(np.clip(x / c.total * 100, 0, 100) + 0.5) if c.total else np.zeros(size)
                score = np.minimum(x, most).astype(np.int64)
                key = score * size - np.arange(size)  # higher score first, then the smaller id
                top = np.argpartition(-key, n - 1)[:n] if size > n else np.arange(size)
                out.append(pd.DataFrame({"set_": int(c.set_), "id": posts["id"].to_numpy()[top], "score": score[top]}))
        return pd.concat(out) if out else pd.DataFrame({"set_": [], "id": [], "score": []})

    left = rows.unionByName(asked).groupBy("p", "s")
    return left.cogroup(known.groupBy("p_", "s_")).applyInPandas(best, "set_ long, id string, score int")


def best_for_users(postings: DataFrame, users: DataFrame, as_of: Column, n: int) -> DataFrame:
    """Best ``n`` postings of every user: user_id, rank, id, score; ties go to the smaller id.

    ``users``: user_id and columns named like the fields of ``Criteria``; equal criteria are scored once. Ids of postings are
    unique text. The plan is the same for any number of sets; only counts come to the driver.
    """
    asked, sets = criteria_table(users)
    wishes = settle(sets.select(*WISH).distinct().withColumn("wish_", F.monotonically_increasing_id()), "criteria-wishes")
    sets = settle(sets.join(wishes.select("wish_", *[F.col(c).alias(f"_{c}") for c in WISH]), [F.col(c) == F.col(f"_{c}") for c in WISH]).select("wish_", *sets.columns), "criteria-wished")
    content = ["f_title", "f_text", "f_location"]
    digest = F.base64(F.unhex(F.substring(F.sha2(F.to_json(F.struct(*content)), 256), 1, 32)))  # 128 bits tell contents apart
    facts = settle(with_facts(with_content_path(postings), as_of).select("id", digest.alias("content"), *content, "f_salary", "f_days"), "criteria-facts")
    needs = settle(_needs(wishes), "criteria-needs")
    kinds, held, terms = _kinds(settle(facts.select("content", *content).distinct(), "criteria-contents"), needs)
    posts = _in_front(facts.join(kinds, "content").select("kind_", "id", F.col("f_salary").cast("double").alias("pay"), F.col("f_days").cast("double").alias("age")), n)
    pairs = settle(_pairs(wishes, needs, terms, held.join(posts.select("kind_").distinct(), "kind_", "left_semi")), "criteria-pairs")
    n_posts, n_sets = posts.count(), sets.count()
    joined = pairs.join(sets.groupBy("wish_").agg(F.count("*").alias("a")), "wish_").join(posts.groupBy("kind_").agg(F.count("*").alias("b")), "kind_").agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0
    if n_posts * n_sets <= PER_JOINED * joined:
        ranked = _tiles(posts, sets, pairs, n, n_posts, n_sets)
    else:
        scored = settle(_scored_pairs(posts, sets, pairs), "criteria-scored")
        above = scored.join(sets.select("set_", _without_terms().alias("rest")), "set_").filter("score > rest").groupBy("set_").agg(F.count("*").alias("n"))
        closed = above.filter(F.col("n") >= n).select("set_")
        open_ = settle(sets.join(closed, "set_", "left_anti"), "criteria-open")
        ranked = scored.join(closed, "set_", "left_semi").unionByName(_tiles(posts, open_, pairs, n, n_posts, open_.count()))
    ranked = top_n_per_key(ranked, ["set_"], [F.col("score").desc(), F.col("id")], n)
    return asked.join(ranked, "set_").select("user_id", "rank", "id", "score")
