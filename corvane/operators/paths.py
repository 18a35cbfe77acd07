"""What a repository-relative path tells: classes, terms, relations between files. Surfaces are in `surfaces`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.joins import lookup_join, shuffled_join
from corvane.operators.surfaces import LANGUAGES, LOWER, UPPER, with_facts, with_surfaces
from corvane.session import materialise, measured

# Words of a path that tell little.
DULL = ("src", "lib", "app", "main", "index", "mod", "core", "test", "tests", "internal", "pkg", "cmd")
# Folders below which a package has a name of its own, and roles within one.
PACKAGE_ROOTS = ("apps", "packages", "crates", "libs", "services")
ROLES = ("src", "tests", "test", "pages", "routes", "api", "server", "cli", "bin")
#: Classes whose files no test is about.
NO_SUBJECTS = ("documentation", "readme", "fixtures", "benchmark_docs", "specs")
#: Rows of one term in a group beyond which its pairs are worked out by signature.
COMMON = 1_024
#: Sets of items a row, on average, and the most items of a row whose sets are listed.
LISTED, MOST_ITEMS = 512, 14


def ascii_lower(col: Column) -> Column:
    """Only ASCII letters are folded."""
    return F.translate(col, UPPER, LOWER)


def language(path: Column) -> Column:
    """The language by the ending, the longest of which counts; null for others."""
    out = None
    for ending, name in LANGUAGES:
        out = F.when(path.endswith(ending), name) if out is None else out.when(path.endswith(ending), name)
    return out


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(path: Column) -> Column:
    """The name up to its last dot; names that begin with their only dot stay whole."""
    return F.regexp_replace(file_name(path), r"(.)\.[^.]*$", "$1")


def subtree_root(path: Column) -> Column:
    """The folder a file counts to: a package (with its role, if one follows), a role with what follows, else the first folder; null for files at the top."""
    steps = F.filter(F.split(F.regexp_replace(path, r"^(\./)+", ""), "/"), lambda s: s != "")
    step = lambda i: F.get(steps, F.lit(i))
    joined = lambda k: F.array_join(F.slice(steps, 1, k), "/")
    return F.when(F.size(steps) <= 1, None).when(step(0).isin(*PACKAGE_ROOTS), F.when(step(2).isin(*ROLES), joined(3)).otherwise(joined(2))).when(step(0).isin(*ROLES), joined(2)).otherwise(step(0))


def path_terms(path: Column) -> Column:
    """Distinct words of a path in the order they come: steps without endings, cut at signs and at a lower-to-upper change, in lower case, from 2 letters on, without dull ones."""
    bare = F.regexp_replace(path, r"\.[^/.]*$", "")
    cut = F.lower(F.regexp_replace(F.regexp_replace(bare, r"([a-z0-9])([A-Z])", "$1 $2"), r"[^A-Za-z0-9]+", " "))
    return F.array_distinct(F.filter(F.split(F.trim(cut), " "), lambda t: (F.length(t) >= 2) & ~t.isin(*DULL)))


#: Bits of the families a path belongs to.
FAMILIES = ("is_test_support", "is_entrypoint", "is_runtime_config_artifact", "is_ci_workflow", "is_readme", "is_bench_support", "is_example_support", "is_scripts_ops", "is_package_surface", "is_build_config", "is_workspace_config", "is_runtime_companion")


def family_bits() -> Column:
    """Over the columns of `with_surfaces`."""
    out = F.lit(0)
    for i, name in enumerate(FAMILIES):
        out = out.bitwiseOR(F.when(F.col(name), 1 << i).otherwise(0))
    return out.cast("long")


def subtree_coverage(paths: DataFrame) -> DataFrame:
    """Per subtree and class the number of paths and the exemplar, the shortest path (then the least): subtree, source_class, paths, exemplar."""
    rows = with_facts(with_surfaces(paths.select("path"), "source_class"), subtree=subtree_root(F.col("path"))).where("subtree is not null")
    return rows.groupBy("subtree", "source_class").agg(F.count(F.lit(1)).alias("paths"), F.min(F.struct(F.length("path").alias("n"), F.col("path").alias("p"))).alias("e")).select("subtree", "source_class", "paths", F.col("e.p").alias("exemplar"))


#: Words that settings and workflows are asked for by, whatever their path says.
ALIASES = {"is_entrypoint": ("entrypoint", "main"), "is_ci_workflow": ("workflow", "ci"), "is_runtime_config_artifact": ("config", "manifest"), "is_test_support": ("tests",), "is_readme": ("documentation",)}


def term_weights(paths: DataFrame, most: int = 24) -> DataFrame:
    """The strongest terms of each path: path, term, weight. A term of the path weighs 3, one of the stem 4 more, an alias of its surfaces 2, every term of an entry point 3 more; of equal weights the lesser term stays."""
    rows = with_facts(with_surfaces(paths.select("path"), *ALIASES), terms=path_terms(F.col("path")), stem_terms=path_terms(file_stem(F.col("path"))))
    weighed = lambda terms, w: F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(w).alias("w")))
    none = F.array().cast("array<string>")
    alias = F.flatten(F.array(*[F.when(F.col(n), F.array(*map(F.lit, words))).otherwise(none) for n, words in ALIASES.items()]))
    every = F.concat(weighed(F.col("terms"), 3), weighed(F.col("stem_terms"), 4), weighed(alias, 2), weighed(F.when(F.col("is_entrypoint"), F.col("terms")).otherwise(none), 3))
    w = Window.partitionBy("path").orderBy(F.col("weight").desc(), "term")
    return rows.select("path", F.explode(every).alias("t")).select("path", "t.*").groupBy("path", "term").agg(F.sum("w").alias("weight")).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).select("path", "term", "weight")


def closest_pairs(left: DataFrame, right: DataFrame, group: list[str], score: Callable[[Column, Column, str, str], Column], fits: Callable[[str, str], Column], k: int, common: int = COMMON, listed: int = LISTED, single: bool = False) -> DataFrame:
    """For each row of `left` the k rows of `right` in its group that score highest: group, left_path, right_path, shared, score.

    Both sides have the columns of `group`, path, terms, stem and traits (a struct). Pairs must have a term or the stem in
    common, and `fits` must hold; `score` gets the number of shared terms, whether stems are equal, and where the traits of
    both are; a column `extra` is 1 where an equal stem is none of the shared terms. On equal scores the lesser path comes first.
    More shared items must never lower the score.

    Rows are met by sets of items, not in pairs: of all rows of `right` that hold a set and have the same traits only the k + 1 least
    are candidates of a row of `left` that holds it too, as the others score no higher for the set they share with it and come later; of
    all candidates of a set, for rows of `left` with the same traits, only the k + 1 that score highest for it. So the result is exact and the work grows with the number of rows. `single` says that the score asks for nothing but equal stems: then sets of
    one item do, and `shared` is only known to be at least what is given. A row of n items has 2^n sets (known by 64-bit hashes); the rows
    with most items are set apart, so that there are at most `listed` sets a row on average, and met by `_pairs_by_items`, with `common`.
    """
    items = F.when(F.col("stem") != "", F.concat("terms", F.array(F.concat(F.lit("="), F.col("stem"))))).otherwise(F.col("terms"))
    kind = F.xxhash64(F.to_json("traits"))
    left = materialise(left.select(*group, "path", "terms", "stem", "traits", F.size(items).alias("n"), kind.alias("l_kind"), F.monotonically_increasing_id().alias("l_id")))
    # The order of these numbers is that of the paths.
    right = materialise(right.select(*group, "path", "terms", "stem", "traits", F.size(items).alias("n"), kind.alias("r_kind")).orderBy("path").withColumn("r_id", F.monotonically_increasing_id()))
    traits = {name: materialise(side.groupBy(f"{name}_kind").agg(F.first("traits").alias(f"{name}_traits"))) for name, side in (("l", left), ("r", right))}
    (most, sets_asked), (fewer, _) = _listable(left, listed), _listable(right, listed)
    most = min(most, fewer)

    def each_item(side: DataFrame, *kept: str) -> DataFrame:
        """A row an item: the group's hash, the item's, the key of both, and whether the item is the stem (2), a term that the stem names (1) or another (0)."""
        rows = side if single else side.where(F.col("n") <= most)
        told = rows.select(*kept, F.xxhash64(*map(F.lit, group), *group).alias("own"), F.lower("stem").alias("named"), F.explode(items).alias("item"))
        flag = F.when(F.col("item").startswith("="), 2).when(F.col("item") == F.col("named"), 1).otherwise(0)
        return told.select(*kept, "own", F.xxhash64("item").alias("h"), flag.alias("flag")).withColumn("key", F.col("own").bitwiseXOR(F.col("h")))

    # Items that the other side has nowhere in the group are in no set that rows share.
    asked, held = each_item(left, "l_id", "l_kind"), each_item(right, "r_id", "r_kind")
    both = materialise(shuffled_join(asked.select("key").distinct(), held.select("key").distinct(), ["key"]))
    bitmap = _bitmap(both, measured(both).rows)
    asked, held = _perhaps_among(asked, *bitmap), _perhaps_among(held, *bitmap)
    # What a set has in common with a row that shares it, in one number: shared terms times 4, 2 for the stem, 1 where it is none of the terms.
    if single:
        asked = asked.select("key", "l_id", "l_kind", F.when(F.col("flag") == 2, 3).otherwise(4).alias("mark"))
    else:
        def sets(side: DataFrame, *kept: str) -> DataFrame:
            """A row a set. Bit i of a set's place tells whether it has item i; the stem is the last, after the term that it names."""
            lists = side.groupBy(kept[0]).agg(*[F.first(c).alias(c) for c in (*kept[1:], "own")], F.array_sort(F.collect_list(F.struct("flag", "h"))).alias("i"))
            lists = materialise(lists.withColumn("stems", F.exists("i", lambda x: x.flag == 2).cast("int")).withColumn("names", F.exists("i", lambda x: x.flag == 1).cast("int")).withColumn("size", F.size("i")))
            keys = F.aggregate("i", F.array("own"), lambda a, x: F.concat(a, F.transform(a, lambda y: y.bitwiseXOR(x.h))))
            return lists.select(*kept, "stems", "names", "size", F.posexplode(keys).alias("at", "key")).where("at > 0")

        has = lambda flag, place: F.when(F.col(flag) == 1, F.expr(f"shiftright(at, {place}) & 1")).otherwise(0)
        asked = sets(asked, "l_id", "l_kind").withColumn("same", has("stems", "size - 1")).withColumn("in_set", has("names", "size - 1 - stems"))
        asked = asked.select("key", "l_id", "l_kind", ((F.bit_count("at") - F.col("same")) * 4 + F.col("same") * 3 - F.col("same") * F.col("in_set")).cast("int").alias("mark"))
        held = _perhaps_among(sets(held, "r_id", "r_kind"), *_bitmap(asked, sets_asked))
    # Both sides are cut by key alone, so none of the steps by key and kind moves them again.
    asked, held = asked.repartition("key"), held.select("key", "r_kind", "r_id").repartition("key")
    w = Window.partitionBy("key", "r_kind").orderBy("r_id")
    least = held.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k + 1).drop("rn")
    # What a set scores with its candidates depends on the traits of the rows that ask, so it is worked out once for all that have the same.
    kinds = asked.groupBy("key", "l_kind").agg(F.first("mark").alias("mark"))
    met = lookup_join(lookup_join(shuffled_join(kinds, least, ["key"]), traits["l"], ["l_kind"]), traits["r"], ["r_kind"])
    met = met.withColumn("shared", F.expr("shiftright(mark, 2)")).withColumn("same", F.expr("mark & 2") > 0).withColumn("extra", F.expr("mark & 1"))
    met = met.where(fits("l_traits", "r_traits")).select("key", "l_kind", "r_id", "shared", score(F.col("shared"), F.col("same"), "l_traits", "r_traits").alias("score"))
    high = Window.partitionBy("key", "l_kind").orderBy(F.col("score").desc(), "r_id")
    met = met.withColumn("rn", F.row_number().over(high)).where(F.col("rn") <= k + 1)
    candidates = met.groupBy("key", "l_kind").agg(F.first("shared").alias("shared"), F.when(F.count(F.lit(1)) > k, F.min("score")).alias("least"), F.collect_list(F.struct("score", "r_id")).alias("c"))
    # Where one set has k + 1 candidates none that scores less than all of them is among the best.
    every = shuffled_join(asked.select("key", "l_id", "l_kind"), candidates, ["key", "l_kind"]).select("l_id", "shared", "least", "c")
    every = every.withColumn("least", F.max("least").over(Window.partitionBy("l_id"))).select("l_id", "shared", "least", F.inline("c")).where("least is null or score >= least")
    best = every.groupBy("l_id", "r_id").agg(F.max(F.struct("score", "shared")).alias("b"))
    first = Window.partitionBy("l_id").orderBy(F.col("b.score").desc(), "r_id")
    best = best.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= k + 1).select("l_id", "r_id", "b.*")
    named_l, named_r = left.select("l_id", *group, F.col("path").alias("left_path")), right.select("r_id", F.col("path").alias("right_path"))
    found = shuffled_join(shuffled_join(best, named_l, ["l_id"]), named_r, ["r_id"]).where("left_path <> right_path").select(*group, "left_path", "right_path", "shared", "score")
    if not single:
        for some, other in ((left.where(F.col("n") > most), right), (left.where(F.col("n") <= most), right.where(F.col("n") > most))):
            found = found.unionByName(_pairs_by_items(some, other, group, score, fits, k, common)) if not some.isEmpty() and not other.isEmpty() else found
    top = Window.partitionBy(*group, "left_path").orderBy(F.col("score").desc(), "right_path")
    return found.withColumn("rn", F.row_number().over(top)).where(F.col("rn") <= k).drop("rn")


def _bitmap(keys: DataFrame, count: int) -> tuple[DataFrame, int]:
    """A bitmap of the some `count` keys of a table, of up to 16 MB in rows of 1 024 words, and its number of bits, as a power of two."""
    bits = min(max(16 * count, 1 << 16).bit_length(), 27)
    told = keys.select(*[c.alias(n) for n, c in _slots(bits).items()]).select("_row", "_word", F.expr("shiftleft(1L, _bit)").alias("w"))
    none = keys.sparkSession.range(1 << (bits - 6)).select(F.shiftright("id", 10).alias("_row"), F.col("id").bitwiseAND(1023).cast("int").alias("_word"), F.lit(0).cast("long").alias("w"))
    words = told.unionByName(none).groupBy("_row", "_word").agg(F.bit_or("w").alias("w")).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_word", "w"))).alias("_words"))
    return materialise(words.select("_row", F.col("_words.w").alias("_words"))), bits


def _slots(bits: int) -> dict[str, Column]:
    slot = F.col("key").bitwiseAND((1 << bits) - 1)
    return {"_row": F.shiftright(slot, 16), "_word": F.shiftright(slot, 6).bitwiseAND(1023).cast("int"), "_bit": slot.bitwiseAND(63).cast("int")}


def _perhaps_among(rows: DataFrame, bitmap: DataFrame, bits: int) -> DataFrame:
    """The rows whose `key` is perhaps one of those of a bitmap, which is broadcast: those that are stay, most others go before any exchange."""
    met = rows.select("*", *[c.alias(n) for n, c in _slots(bits).items()]).join(F.broadcast(bitmap), "_row")
    return met.where(F.getbit(F.get("_words", F.col("_word")), F.col("_bit")) == 1).select(*rows.columns)


def _listable(side: DataFrame, listed: int) -> tuple[int, int]:
    """The greatest number of items up to which the sets of the rows that have no more are at most `listed` a row of all, and the number of these sets."""
    sizes = {r.n: r.rows for r in side.groupBy(F.least("n", F.lit(31)).alias("n")).agg(F.count(F.lit(1)).alias("rows")).collect()}
    all_, most, sets, kept = sum(sizes.values()), 0, 0, 0
    for n in range(MOST_ITEMS + 1):
        sets += sizes.get(n, 0) << n
        if sets <= listed * all_:
            most, kept = n, sets
    return most, kept


def _pairs_by_items(left: DataFrame, right: DataFrame, group: list[str], score: Callable[[Column, Column, str, str], Column], fits: Callable[[str, str], Column], k: int, common: int = COMMON) -> DataFrame:
    """`closest_pairs` by pairs of rows with an item in common.

    Terms and stems are joined by equality. Of items that more than `common` rows of a group have, pairs are not formed: all
    rows with the same such items and traits score alike for whoever shares nothing rarer with them, so only the k + 1 least of
    them are candidates. The result is exact, and no pair is formed of two rows that have only common items.
    """
    items = F.when(F.col("stem") != "", F.concat("terms", F.array(F.concat(F.lit("="), F.col("stem"))))).otherwise(F.col("terms"))
    sides = {}
    for name, side in (("l", left), ("r", right)):
        sides[name] = side.select(*group, F.col("path").alias(f"{name}_path"), items.alias(f"{name}_items"), F.col("traits").alias(f"{name}_traits"))
    counts = sides["r"].select(*group, F.explode("r_items").alias("item")).groupBy(*group, "item").agg(F.count(F.lit(1)).alias("n"))
    hot = materialise(counts.where(F.col("n") > common).drop("n"))
    split = {}
    for name, side in sides.items():
        each = side.select(*group, f"{name}_path", F.explode(f"{name}_items").alias("item"))
        marked = lookup_join(each, hot, [*group, "item"], "left_semi", salt_on=[f"{name}_path"])
        split[name] = shuffled_join(side, marked.groupBy(*group, f"{name}_path").agg(F.array_sort(F.collect_set("item")).alias(f"{name}_hot")), [*group, f"{name}_path"], "left")
        split[name] = materialise(split[name].withColumn(f"{name}_hot", F.coalesce(f"{name}_hot", F.array().cast("array<string>"))))

    def scored(pairs: DataFrame, one: str, other: str) -> DataFrame:
        both = F.array_intersect(one, other)
        same = F.exists(both, lambda i: i.startswith("="))
        stem = F.substring(F.get(F.filter(both, lambda i: i.startswith("=")), F.lit(0)), 2, 2_147_483_647)
        told = pairs.withColumn("same", same).withColumn("shared", F.size(both) - F.col("same").cast("int"))
        told = told.withColumn("extra", F.when(F.col("same"), (~F.array_contains(both, F.lower(stem))).cast("int")).otherwise(0))
        return told.where((F.col("shared") > 0) | F.col("same")).where(fits("l_traits", "r_traits")).withColumn("score", score(F.col("shared"), F.col("same"), "l_traits", "r_traits"))

    # Shared rare items are counted over pairs of numbers; what else tells of a pair is looked up once it is formed.
    rare = lambda name: split[name].select(*group, F.xxhash64(*group, f"{name}_path").alias(f"{name}_id"), F.explode(F.array_except(f"{name}_items", f"{name}_hot")).alias("item"))
    stem_too = F.col("item").startswith("=")
    counted = shuffled_join(rare("l"), rare("r"), [*group, "item"]).groupBy("l_id", "r_id").agg(F.sum(F.when(stem_too, 0).otherwise(1)).cast("int").alias("shared"), F.max(F.when(stem_too, F.substring("item", 2, 2_147_483_647))).alias("stem"))
    told = {n: materialise(split[n].select(F.xxhash64(*group, f"{n}_path").alias(f"{n}_id"), *(group if n == "l" else []), f"{n}_path", f"{n}_items", f"{n}_hot", f"{n}_traits")) for n in split}
    met = lookup_join(lookup_join(counted, told["l"], ["l_id"], salt_on=["r_id"]), told["r"], ["r_id"], salt_on=["l_id"]).where("l_path <> r_path")
    common_items = F.when((F.size("l_hot") > 0) & (F.size("r_hot") > 0), F.array_intersect("l_hot", "r_hot")).otherwise(F.array().cast("array<string>"))
    met = met.withColumn("both", common_items).withColumn("hot_stem", F.get(F.filter("both", lambda i: i.startswith("=")), F.lit(0)))
    met = met.withColumn("stem", F.coalesce("stem", F.substring("hot_stem", 2, 2_147_483_647))).withColumn("same", F.col("stem").isNotNull())
    met = met.withColumn("shared", F.col("shared") + F.size("both") - F.col("hot_stem").isNotNull().cast("int"))
    met = met.withColumn("extra", F.when(F.col("same"), (~(F.array_contains("l_items", F.lower("stem")) & F.array_contains("r_items", F.lower("stem")))).cast("int")).otherwise(0))
    near = met.where((F.col("shared") > 0) | F.col("same")).where(fits("l_traits", "r_traits")).withColumn("score", score(F.col("shared"), F.col("same"), "l_traits", "r_traits"))
    best_rare = Window.partitionBy("l_id").orderBy(F.col("score").desc(), "r_path")
    by_rare = near.withColumn("rn", F.row_number().over(best_rare)).where(F.col("rn") <= k).select(*group, "l_path", "r_path", "shared", "score")
    kinds = {n: [*group, f"{n}_hot", f"{n}_traits"] for n in split}
    w = Window.partitionBy(*group, "r_hot", "r_traits").orderBy("r_path")
    least = split["r"].where(F.size("r_hot") > 0).select(*kinds["r"], "r_path").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k + 1).drop("rn")
    asked = split["l"].where(F.size("l_hot") > 0).select(*kinds["l"]).distinct()
    r_kinds = least.select(*kinds["r"]).distinct()
    kind_pairs = shuffled_join(asked.withColumn("item", F.explode("l_hot")), r_kinds.withColumn("item", F.explode("r_hot")), [*group, "item"]).drop("item").distinct()
    ranked = shuffled_join(scored(kind_pairs, "l_hot", "r_hot"), least, kinds["r"])
    first = Window.partitionBy(*kinds["l"]).orderBy(F.col("score").desc(), "r_path")
    best = ranked.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= k + 1).select(*kinds["l"], "r_path", "shared", "score")
    by_kind = shuffled_join(split["l"].select(*kinds["l"], "l_path"), best, kinds["l"]).where("l_path <> r_path").select(*group, "l_path", "r_path", "shared", "score")
    every = by_rare.unionByName(by_kind).groupBy(*group, "l_path", "r_path").agg(F.max("shared").alias("shared"), F.max("score").alias("score"))
    top = Window.partitionBy(*group, "l_path").orderBy(F.col("score").desc(), "r_path")
    return every.withColumn("rn", F.row_number().over(top)).where(F.col("rn") <= k).select(*group, F.col("l_path").alias("left_path"), F.col("r_path").alias("right_path"), "shared", "score")


def test_stem(path: Column) -> Column:
    """The stem without what tests add to it, in lower case."""
    return F.lower(F.regexp_replace(file_stem(F.regexp_replace(path, r"\.(spec|test)(\.[^.]*)$", "$2")), r"^test_|_tests?$|Test$", ""))


def test_subject_links(paths: DataFrame, per_test: int = 6, per_subject: int = 6) -> DataFrame:
    """Tests and the sources they are about: repository_id, test_path, subject_path, shared, score.

    A link needs a shared term and the same language (or none; PHP and its templates count as one). Score: 10 a shared term, 6 for an
    equal stem, 3 for the language, 2 for a runtime subject, 1 for one of support. The best of each test are kept, then the best of each subject.
    """
    rows = with_surfaces(paths.select("repository_id", "path"), "language", "path_class", "source_class", "is_test_support", "is_test_harness")
    signal = file_name(F.col("path")).rlike(r"^test_|_test\.|Test\.|\.spec\.|\.test\.")
    rows = with_facts(rows, terms=path_terms(F.col("path")), stem=test_stem(F.col("path")), test=(F.col("source_class") == "tests") | F.col("is_test_support") | F.col("is_test_harness") | signal)
    rows = materialise(rows.withColumn("traits", F.struct("language", "path_class")).select("repository_id", "path", "terms", "stem", "test", "source_class", "traits"))
    tests, subjects = rows.where("test"), rows.where(~F.col("test") & ~F.col("source_class").isin(*NO_SUBJECTS))

    def fits(a: str, b: str) -> Column:
        php = F.col(f"{a}.language").isin("php", "blade") & F.col(f"{b}.language").isin("php", "blade")
        return (F.col("shared") > 0) & F.coalesce((F.col(f"{a}.language") == F.col(f"{b}.language")) | php, F.lit(True))

    def score(shared: Column, same: Column, a: str, b: str) -> Column:
        kind = F.col(f"{b}.path_class")
        alike = F.coalesce(F.col(f"{a}.language") == F.col(f"{b}.language"), F.lit(False))
        return shared * 10 + same.cast("int") * 6 + alike.cast("int") * 3 + F.when(kind == "runtime", 2).when(kind == "support", 1).otherwise(0)

    first = closest_pairs(tests, subjects, ["repository_id"], score, fits, per_test)
    w = Window.partitionBy("repository_id", "right_path").orderBy(F.col("score").desc(), "left_path")
    return first.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_subject).select("repository_id", F.col("left_path").alias("test_path"), F.col("right_path").alias("subject_path"), "shared", "score")


#: Kinds of what stands beside an entry point; the first that holds counts.
ENTRY_KINDS = (("is_build_workflow", "entrypoint_workflow"), ("is_runtime_config_artifact", "entrypoint_config"), ("is_build_config", "entrypoint_config"), ("is_package_surface", "entrypoint_package"), ("is_workspace_config", "entrypoint_workspace"), ("is_runtime_companion", "companion_surface"))
#: What stands beside runtime files.
COMPANIONS = ("is_test_support", "is_test_harness", "is_package_surface", "is_build_config", "is_workspace_config", "is_build_workflow", "is_runtime_config_artifact")


def companions(paths: DataFrame, most: int = 8) -> DataFrame:
    """What belongs to entry points and runtime files of the same subtree: repository_id, src_path, dst_path, kind, score; at most `most` a source and rule.

    A pair shares a term or the stem. Beside an entry point stand workflows, settings, packages and runtime files: 100, 12 a shared
    term (an equal stem is one too, eight count at most), 18 for an equal stem, 6 for an equal class. Beside a runtime file stand tests and settings: 80, 20 for an equal stem.
    """
    told = with_surfaces(paths.select("repository_id", "path"), "is_entrypoint", "source_class", *dict.fromkeys([*(n for n, _ in ENTRY_KINDS), *COMPANIONS]))
    beside = F.when(F.col(ENTRY_KINDS[0][0]), ENTRY_KINDS[0][1])
    for name, kind in ENTRY_KINDS[1:]:
        beside = beside.when(F.col(name), kind)
    companion = F.lit(False)
    for name in COMPANIONS:
        companion = companion | F.col(name)
    rows = with_facts(told, subtree=subtree_root(F.col("path")), beside=beside, companion=companion, terms=path_terms(F.col("path")), stem=file_stem(F.col("path"))).where("subtree is not null")
    rows = materialise(rows.select("repository_id", "subtree", "path", "terms", "stem", "source_class", "beside", "companion", "is_entrypoint", "is_runtime_companion"))
    group = ["repository_id", "subtree"]
    entry = lambda shared, same, a, b: F.least(shared + F.col("extra"), F.lit(8)) * 12 + same.cast("int") * 18 + (F.col(f"{a}.source_class") == F.col(f"{b}.source_class")).cast("int") * 6 + 100
    traits = lambda df, *c: df.withColumn("traits", F.struct(*c))
    one = closest_pairs(traits(rows.where("is_entrypoint"), "source_class"), traits(rows.where("beside is not null"), "source_class", "beside"), group, entry, lambda a, b: F.lit(True), most)
    one = shuffled_join(one, rows.select("repository_id", F.col("path").alias("right_path"), F.col("beside").alias("kind")), ["repository_id", "right_path"])
    nothing = F.lit(0).alias("none")
    two = closest_pairs(traits(rows.where("is_entrypoint or is_runtime_companion"), nothing), traits(rows.where("companion"), nothing), group, lambda shared, same, a, b: same.cast("int") * 20 + 80, lambda a, b: F.lit(True), most, single=True)
    two = two.withColumn("kind", F.lit("companion_surface")).select(*one.columns)
    return one.unionByName(two).groupBy("repository_id", "left_path", "right_path", "kind").agg(F.max("score").alias("score")).select("repository_id", F.col("left_path").alias("src_path"), F.col("right_path").alias("dst_path"), "kind", "score")


def name_overlap(symbols: DataFrame, most: int = 8) -> DataFrame:
    """Files of one subtree that declare symbols of the same name: src_path, dst_path, score; at most `most` a source.

    `symbols` has path and name; letters' case counts not. Score: 96, 8 for the same language. Of a name's files only the least in path,
    of each language and of all, can be among the best, so a name that stands everywhere forms no pairs of all its files.
    """
    rows = with_facts(symbols.select("path", F.lower("name").alias("name")).where("path is not null and name <> ''").distinct(), subtree=subtree_root(F.col("path")), language=language(F.lower("path"))).where("subtree is not null")
    rows = materialise(rows)
    within = Window.partitionBy("subtree", "name", "language").orderBy("path")
    over = Window.partitionBy("subtree", "name").orderBy("path")
    least = rows.select(F.col("path").alias("dst_path"), "subtree", "name", F.col("language").alias("dst_language"), F.row_number().over(within).alias("a"), F.row_number().over(over).alias("b")).where((F.col("a") <= most + 1) | (F.col("b") <= most + 1)).drop("a", "b")
    pairs = lookup_join(rows.withColumnRenamed("path", "src_path"), least, ["subtree", "name"], salt_on=["src_path"]).where("src_path <> dst_path")
    same = F.coalesce(F.col("language") == F.col("dst_language"), F.lit(False)).cast("int")
    scored = pairs.groupBy("src_path", "dst_path").agg(F.max(96 + 8 * same).alias("score"))
    w = Window.partitionBy("src_path").orderBy(F.col("score").desc(), "dst_path")
    return scored.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).select("src_path", "dst_path", "score")
