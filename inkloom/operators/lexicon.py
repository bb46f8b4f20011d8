"""Queries over the category lexicon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ranking import previous_row

# Categories that are always searched for, in insertion order.
CORE_CATEGORIES = ("seal", "calligraphy", "repair_marks")
SERVING_MIN_WEIGHT = 0.3


def serving_prompts(prompts: DataFrame, min_weight: float = SERVING_MIN_WEIGHT) -> DataFrame:
    """Prompts that take part in detection: not shadow, weight high enough."""
    return prompts.where((F.col("source") != "shadow") & (F.col("weight") >= min_weight))


def ranked_prompts(prompts: DataFrame, categories: DataFrame) -> DataFrame:
    """Serving prompts with their category's names, strongest first."""
    cats = categories.select(F.col("id").alias("category_id"), "name_zh", "name_en",
                             F.col("confidence").alias("category_confidence"))
    return serving_prompts(prompts).join(cats, "category_id")


def categories_by_material(affinity: DataFrame, categories: DataFrame, *, limit: int = 50,
                           min_affinity: float = 0.3, live_only: bool = True) -> DataFrame:
    """Best categories of every material family, ties broken by category id."""
    cats = categories.where("deleted_at IS NULL") if live_only else categories
    cats = cats.select(F.col("id").alias("category_id"), "name_zh", "name_en", "name_template", "confidence")
    order = Window.partitionBy("material_family").orderBy(
        F.desc("affinity"), F.desc("confidence"), F.asc("category_id"))
    return (affinity.where(F.col("affinity") >= min_affinity).join(cats, "category_id")
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit))


def categories_with_aliases(categories: DataFrame, aliases: DataFrame) -> DataFrame:
    """Categories with their alias list and the alias of lowest priority."""
    per_cat = aliases.groupBy(F.col("category_id").alias("id")).agg(
        F.array_join(F.sort_array(F.collect_list("preset_name")), "|").alias("preset_aliases"),
        F.min_by("preset_name", F.struct("priority", "preset_name")).alias("primary_preset_name"))
    return categories.select("id", "name_zh", "name_en", "name_template", "confidence").join(per_cat, "id", "left")


def categories_without_prompts(categories: DataFrame, prompts: DataFrame) -> DataFrame:
    return categories.join(prompts.select(F.col("category_id").alias("id")), "id", "left_anti")


def category_info(categories: DataFrame, prompts: DataFrame, priors: DataFrame, affinity: DataFrame,
                  default_affinity: float = 0.5) -> DataFrame:
    """One row per category and requested family: prompts, area budget, affinity.

    The reference takes any affinity row of the category; here the family of the
    row decides, and a category without one gets the default.
    """
    served = (prompts.where(F.col("weight") >= SERVING_MIN_WEIGHT).groupBy("category_id")
              .agg(F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("o"), "prompt", "weight", "lang")))
                   .alias("_p")))
    served = served.select("category_id", F.transform("_p", lambda s: F.struct(s["prompt"].alias("text"), s["weight"].alias("weight"), s["lang"].alias("lang"))).alias("prompts"))
    budget = priors.select("category_id", "area_budget_min", "area_budget_max")
    return (categories.select(F.col("id").alias("category_id"), "name_zh", "name_en", "name_template", "confidence")
            .join(served, "category_id", "left").join(budget, "category_id", "left")
            .join(affinity, "category_id", "left")
            .withColumn("affinity", F.coalesce("affinity", F.lit(default_affinity))))


def strip_order_prefix(name: Column) -> Column:
    return F.regexp_replace(name, r"^\d+[A-Da-d]?_", "")


def name_tokens(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(strip_order_prefix(name), r"[_\s]+"), lambda t: t != ""))


def english_tokens(name: Column) -> Column:
    """Distinct lower-case words of four or more letters, from runs of three or more."""
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"([A-Za-z_]{3,})"), F.lit(1))
    words = F.flatten(F.transform(runs, lambda r: F.split(r, "_")))
    return F.array_distinct(F.filter(words, lambda t: F.length(t) >= 4))


def best_word_match(names: DataFrame, categories: DataFrame, hot: int = 64) -> DataFrame:
    """(name, cid, score): the category that shares most words with the ``tokens`` of a name, the smallest id on ties.

    A category's whole Chinese name counts as one word, its English name word by word.  Words of at most ``hot`` categories
    bring names and categories together one by one, and such a pair is scored over all words at once.  Categories that
    share nothing but commoner words with a name need not meet it: among all that hold the same common words only the
    smallest id can win, so those profiles meet the distinct common parts of names, and only of names whose best pair so
    far does not beat all their common words together.
    """
    cats = categories.select(F.col("id").alias("cid"), F.coalesce("name_zh", F.lit("")).alias("zh"), F.array_distinct(F.filter(
        F.split(F.coalesce("name_en", F.lit("")), r"[_\s]+"), lambda t: t != "")).alias("en"))
    vocab = cats.select("cid", "zh", "en", F.explode(F.concat(
        F.transform("en", lambda t: F.struct(t.alias("t"), F.lit(1).alias("src"))),
        F.when(F.col("zh") != "", F.array(F.struct(F.col("zh").alias("t"), F.lit(0).alias("src"))))
        .otherwise(F.array().cast("array<struct<t:string,src:int>>")))).alias("w")).select("cid", "zh", "en", "w.t", "w.src")
    common = vocab.groupBy("t").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("src").alias("most")).where(F.col("_n") > hot).select("t", "most")
    words = names.select("name", "tokens", F.explode("tokens").alias("t"))
    score = F.size(F.array_intersect("tokens", "en")) + F.array_contains("tokens", F.col("zh")).cast("int")
    met = words.join(vocab.join(common, "t", "left_anti"), "t").select("name", "cid", score.alias("score"))
    order = lambda: F.min_by(F.struct("cid", "score"), F.struct(-F.col("score"), F.col("cid"))).alias("b")
    rare = met.groupBy("name").agg(order()).select("name", "b.*")
    # what is shared with common words alone
    entry = F.array_sort(F.collect_set(F.struct("t", "src")))
    profiles = vocab.join(common, "t", "left_semi").groupBy("cid").agg(entry.alias("profile")).groupBy("profile").agg(F.min("cid").alias("cid"))
    part = words.join(common, "t").groupBy("name").agg(F.array_sort(F.collect_set("t")).alias("part"), F.sum("most").alias("most"))
    part = part.join(rare.select("name", F.col("score").alias("_s")), "name", "left").where(F.col("_s").isNull() | (F.col("_s") <= F.col("most")))
    held = part.select("part").distinct().select("part", F.explode("part").alias("t")) \
        .join(profiles.select("cid", F.explode("profile").alias("w")).select("cid", "w.t"), "t")
    shared = held.groupBy("part", "cid").agg(F.count(F.lit(1)).cast("int").alias("score")).groupBy("part").agg(order()).select("part", "b.*")
    both = rare.unionByName(part.join(shared, "part").select("name", "cid", "score"))
    return both.groupBy("name").agg(order()).select("name", "b.*")


def resolve_category_ids(names: DataFrame, categories: DataFrame, aliases: DataFrame, name_col: str = "name") -> DataFrame:
    """Name -> category id: alias, then exact name, then most shared words.

    Works on distinct names, so a name that fills a third of the input is
    matched once; names that an alias or a spelling settles meet no words.
    """
    distinct = names.select(F.col(name_col).alias("name")).where("name <> ''").distinct()
    keyed = distinct.withColumn("key", F.explode(F.array_distinct(F.array(
        F.struct(F.lit(0).alias("p"), F.col("name").alias("k")),
        F.struct(F.lit(1).alias("p"), strip_order_prefix(F.col("name")).alias("k"))))))
    keyed = keyed.select("name", "key.p", "key.k")
    by_alias = keyed.join(aliases.select(F.col("preset_name").alias("k"), F.col("category_id").alias("cid")), "k") \
        .select("name", F.lit(0).alias("tier"), "p", F.lit(0).alias("score"), "cid")
    spelled = categories.select(F.col("id").alias("cid"), F.explode(F.array_distinct(F.array_compact(
        F.array("name_zh", "name_en", "name_template")))).alias("k"))
    by_name = keyed.join(spelled, "k").select("name", F.lit(1).alias("tier"), "p", F.lit(0).alias("score"), "cid")
    exact = by_alias.unionByName(by_name)
    open_ = distinct.join(exact.select("name"), "name", "left_anti").select("name", name_tokens(F.col("name")).alias("tokens"))
    by_word = best_word_match(open_, categories).select("name", F.lit(2).alias("tier"), F.lit(0).alias("p"), "score", "cid")
    best = exact.unionByName(by_word).groupBy("name").agg(
        F.min_by(F.struct("cid", "tier"), F.struct("tier", "p", -F.col("score"), "cid")).alias("b"))
    return names.select(F.col(name_col).alias("name")).join(
        best.select("name", F.col("b.cid").alias("category_id"), F.col("b.tier").alias("tier")), "name", "left")


def learned_weight(pairs: DataFrame, prompts: DataFrame) -> DataFrame:
    """Known weight per (category, prompt) without shadow rows; NULL if unknown."""
    known = prompts.where("source <> 'shadow'").groupBy("category_id", "prompt").agg(F.max("weight").alias("old_weight"))
    return pairs.join(known, ["category_id", "prompt"], "left")


def best_learned_prompt(prompts: DataFrame) -> DataFrame:
    """Heaviest English prompt with feedback per category; ties to the first prompt."""
    seen = prompts.where("lang = 'en' AND (n_accept > 0 OR n_reject > 0)")
    return seen.groupBy("category_id").agg(
        F.min_by(F.struct("prompt", "weight"), F.struct(-F.col("weight"), F.col("prompt"))).alias("b")) \
        .select("category_id", F.col("b.prompt").alias("prompt"), F.col("b.weight").alias("weight"))


def top_prompts(prompts: DataFrame, k: int = 5) -> DataFrame:
    order = Window.partitionBy("category_id").orderBy(F.desc("weight"), F.asc("prompt"))
    return prompts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def with_core_first(ids: Column, core: tuple[str, ...] = CORE_CATEGORIES) -> Column:
    """Missing core categories go to the front, the last listed one first."""
    lead = F.array(*[F.lit(c) for c in reversed(core)])
    return F.concat(F.array_except(lead, ids), ids)


def hybrid_ids(preset_ids: Column, auto_ids: Column) -> Column:
    """Preset ids, then automatic ones that are not there yet."""
    return F.array_distinct(F.concat(preset_ids, auto_ids))


def supplement_preset(selected: DataFrame, preset_names: list[str], *, corpus: str = "", min_affinity: float = 0.6,
                      max_supplement: int = 3, group: str = "material_family") -> DataFrame:
    """Lexicon categories that a preset does not cover yet, best few per group.

    ``selected`` has name, name_zh, affinity and rank (selection order).  The
    preset is a configuration file, so its names and text are literals here.
    """
    lower = [n.lower() for n in preset_names if n]
    text = " ".join(lower + [corpus.lower()])
    rname, zh = F.lower("name"), F.lower(F.coalesce("name_zh", F.lit("")))
    covered = F.when((rname != "") & F.lit(bool(corpus)), F.contains(F.lit(corpus.lower()), rname)).otherwise(F.lit(False))
    for n in lower:
        covered |= (rname != "") & (F.contains(rname, F.lit(n)) | F.contains(F.lit(n), rname))
        covered |= (zh != "") & F.contains(F.lit(n), zh)
    covered |= F.arrays_overlap(english_tokens(F.col("name")), english_tokens(F.lit(text)))
    fits = selected.where(~covered & (F.col("affinity").isNull() | (F.col("affinity") >= min_affinity)))
    order = Window.partitionBy(group).orderBy("rank")
    return fits.withColumn("added", F.row_number().over(order)).where(F.col("added") <= max_supplement)


def affinity_from_cooccurrence(observed: DataFrame, old: DataFrame, keep: float = 0.7) -> DataFrame:
    """Share of a category within its family, blended with the stored affinity."""
    per = observed.groupBy("material_family", "category_id").agg(F.count(F.lit(1)).alias("_n"))
    total = observed.groupBy("material_family").agg(F.count(F.lit(1)).alias("_t"))
    share = per.join(total, "material_family").select("material_family", "category_id", (F.col("_n") / F.col("_t")).alias("_new"))
    both = old.join(share, ["material_family", "category_id"], "full_outer")
    blended = F.when(F.col("affinity").isNull(), F.col("_new")).when(F.col("_new").isNull(), F.col("affinity")) \
        .otherwise(keep * F.col("affinity") + (1 - keep) * F.col("_new"))
    return both.select("material_family", "category_id", blended.alias("affinity"))


def lexicon_stats(categories: DataFrame, prompts: DataFrame, versions: DataFrame) -> DataFrame:
    """Counts and the active version as (item, value) rows."""
    count = lambda df, n: df.agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit(n).alias("item"), "value")
    active = versions.where("activated_at IS NOT NULL").agg(
        F.max_by("version_id", F.struct("activated_at", "version_id")).alias("value"))
    return count(categories, "categories").unionByName(count(prompts, "prompts")).unionByName(
        count(prompts.where("source <> 'shadow'"), "live_prompts")).unionByName(
        active.select(F.lit("active_version").alias("item"), "value"))


def lexicon_health(categories: DataFrame, prompts: DataFrame, affinity: DataFrame, versions: DataFrame, *,
                   core: tuple[str, ...] = CORE_CATEGORIES, min_categories: int = 20, min_prompts: int = 40,
                   min_affinities: int = 100, min_core_confidence: float = 0.85) -> DataFrame:
    """Six data-quality checks as (check, passed, detail) rows."""
    def at_least(df, name, least):
        return df.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("check"), (F.col("n") >= least).alias("passed"), F.col("n").alias("detail"))

    def none_of(df, name):
        return df.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("check"), (F.col("n") == 0).alias("passed"), F.col("n").alias("detail"))

    rows = [
        at_least(categories, "categories", min_categories),
        at_least(prompts.where("source = 'seed'"), "seed_prompts", min_prompts),
        at_least(affinity, "affinities", min_affinities),
        at_least(versions.where("activated_at IS NOT NULL"), "active_version", 1),
        none_of(categories_without_prompts(categories, prompts), "orphan_categories"),
        none_of(categories.where(F.col("id").isin(*core) & (F.col("confidence") < min_core_confidence)), "core_confidence"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


# ---- hierarchy -------------------------------------------------------------

def ancestors(edges: DataFrame) -> DataFrame:
    """(id, ancestor, distance) for every category; chains stop before a cycle repeats.

    One join per level, run until no chain grows; each level is written to the
    shared folder so that a lost executor does not replay the climb.
    """
    parent = edges.where("parent_id IS NOT NULL").select(F.col("id").alias("_c"), F.col("parent_id").alias("_p"))
    level = cut_lineage(edges.where("parent_id IS NOT NULL AND parent_id <> id").select(
        "id", F.col("parent_id").alias("ancestor"), F.lit(1).alias("distance"),
        F.array("id", "parent_id").alias("seen")))
    found = level
    while not level.isEmpty():
        nxt = level.join(parent, level.ancestor == parent._c).where(~F.array_contains("seen", F.col("_p"))).select(
            "id", F.col("_p").alias("ancestor"), (F.col("distance") + 1).alias("distance"),
            F.concat("seen", F.array("_p")).alias("seen"))
        level = cut_lineage(nxt)
        found = found.unionByName(level)
    return found.select("id", "ancestor", "distance")


def materialized_paths(edges: DataFrame) -> DataFrame:
    """``/root/child/`` path of every category, the root itself being ``/``.

    The path lists the ancestors below the root and the category itself.
    """
    chain = ancestors(edges).groupBy("id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("o"), "ancestor"))), lambda s: s["ancestor"]).alias("up"))
    joined = edges.select("id").join(chain, "id", "left")
    inner = F.concat(F.slice("up", 2, F.size("up")), F.array("id"))
    return joined.select("id", F.when(F.col("up").isNull(), F.lit("/")).otherwise(
        F.concat(F.lit("/"), F.array_join(inner, "/"), F.lit("/"))).alias("path"))


def cyclic_inserts(proposed: DataFrame, edges: DataFrame) -> DataFrame:
    """Proposed (id, parent_id) pairs with ``creates_cycle``: parent below the child or equal to it."""
    up = ancestors(edges).select(F.col("id").alias("parent_id"), F.col("ancestor").alias("id"), F.lit(True).alias("_hit"))
    return proposed.join(up, ["id", "parent_id"], "left").select(
        "id", "parent_id", (F.coalesce("_hit", F.lit(False)) | (F.col("id") == F.col("parent_id"))).alias("creates_cycle"))


def inherit_priors(categories: DataFrame, priors: DataFrame) -> DataFrame:
    """What happens when each category without priors copies those of its parent."""
    own = priors.select(F.col("category_id").alias("id"), F.lit(True).alias("_own"))
    par = priors.select(F.col("category_id").alias("parent_id"), "area_budget_min", "area_budget_max", F.lit(True).alias("_par"))
    joined = categories.select("id", "parent_id").join(own, "id", "left").join(par, "parent_id", "left")
    status = F.when(F.col("_own"), "has_own_priors").when(F.col("parent_id").isNull(), "no_parent") \
        .when(F.col("_par").isNull(), "parent_without_priors").otherwise("inherited")
    took = status == "inherited"
    return joined.select("id", "parent_id", status.alias("status"),
                         F.when(took, F.col("area_budget_min")).alias("area_budget_min"),
                         F.when(took, F.col("area_budget_max")).alias("area_budget_max"),
                         F.when(took, F.lit(0)).alias("n_samples"))


# ---- version chain ---------------------------------------------------------

def version_parents(versions: DataFrame) -> DataFrame:
    """Each version's parent: its own or else the latest created before it.

    The total order is range-partitioned and one row per partition is carried on, so no pile of versions of one day or
    second meets in a task.
    """
    return previous_row(versions, ["created_at", "version_id"], "version_id", "_before") \
        .withColumn("parent_version_id", F.coalesce("parent_version_id", "_before")).select(*versions.columns)


def activate_version(versions: DataFrame, version_id: str, now: int) -> DataFrame:
    return versions.withColumn("activated_at", F.when(F.col("version_id") == version_id, F.lit(now)).otherwise(F.col("activated_at")))


def rollback_version(versions: DataFrame, version_id: str, now: int) -> DataFrame:
    """Snapshot after activating the parent of ``version_id``; unchanged without a parent."""
    parent = versions.where(F.col("version_id") == version_id).select(F.col("parent_version_id").alias("_target")).where("_target IS NOT NULL")
    joined = versions.join(F.broadcast(parent.limit(1)), versions.version_id == parent._target, "left")
    return joined.withColumn("activated_at", F.when(F.col("_target").isNotNull(), F.lit(now)).otherwise(F.col("activated_at"))).drop("_target")


def drop_stale_versions(versions: DataFrame, cutoff: int) -> DataFrame:
    return versions.where("activated_at IS NOT NULL").unionByName(
        versions.where((F.col("activated_at").isNull()) & (F.col("created_at") >= cutoff)))


def version_history(versions: DataFrame, limit: int = 10) -> DataFrame:
    return versions.orderBy(F.desc("created_at"), F.desc("version_id")).limit(limit)
