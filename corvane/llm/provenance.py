"""Generated, minified or vendored source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.joins import lookup_join
from corvane.session import materialise, measured
from corvane.tables import compact_digest, norm_key, norm_path

# Names of folders that hold third-party copies, whatever lies in them.
COPIES = ("node_modules", "bower_components", "jspm_packages", "vendor", "vendored", "vendors", "third_party", "third-party", "thirdparty", "3rdparty", "3rd_party", "3rd-party", "extern", "externals", "pods", "carthage", "site-packages", "dist-packages", "godeps", ".venv", "virtualenv", ".cargo", ".yarn")
# Names of folders that tools write into.
WRITTEN = ("generated", "__generated__", "_generated", "autogen", "gen", "generated-sources", "generated_sources", "gensrc", "__pycache__", ".next", ".nuxt", "dist", ".dart_tool")
# Endings of source files; data in other formats is not kept as code.
SOURCE = ("c", "cc", "cpp", "cxx", "h", "hh", "hpp", "cs", "css", "cjs", "clj", "dart", "erl", "ex", "exs", "f90", "fs", "go", "groovy", "hs", "java", "jl", "js", "jsx", "kt", "kts", "lua", "m", "mjs", "ml", "mm", "nim", "php", "pl", "pm", "ps1", "py", "r", "rb", "roc", "rs", "scala", "sh", "sol", "sql", "swift", "ts", "tsx", "v", "vb", "vue", "zig")

#: A folder of one package in one version, such as parser-4.2.1.
VERSIONED = r"[^/]-v?\d+\.\d+[^/]*/"
#: What tools call their outputs; matched against the name alone, in lower case.
GENERATED_NAME = "|".join(
    (
        r"\.pb\.[a-z+]+$", r"_pb2(_grpc)?\.pyi?$", r"_(grpc_)?pb\.(d\.ts|js|rb)$", r"\.g\.(dart|cs|i\.cs)$", r"\.freezed\.dart$", r"\.designer\.(cs|vb)$",
        r"^lex\.yy\.c", r"\.yy\.(c|cc|cpp|h)$", r"\.tab\.(c|cc|cpp|h|hh|hpp)$", r"^moc_.*\.(c|cc|cpp)$", r"^ui_.*\.h$", r"^qrc_.*\.(cc|cpp)$",
        r"^zz_generated[._]", r"[._-]generated\.[a-z+]+$", r"[._]codegen\.[a-z+]+$", r"[._]gen\.(go|rs|ts|js|py|java|kt)$", r"\.capnp\.(c|cc|h|rs|c\+\+)$",
        r"^(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|cargo\.lock|poetry\.lock|composer\.lock|gemfile\.lock|go\.sum)$",
    )
)
#: A part of the name, between dots, dashes and underscores, that each of these has.
GENERATED_PARTS = ("pb", "pb2", "g", "freezed", "designer", "yy", "tab", "moc", "ui", "qrc", "generated", "codegen", "gen", "capnp", "lock", "sum")
#: What bundlers and compressors call theirs; only names with one of the endings are compared.
DELIVERED_NAME = "|".join((r"[._-]min\.(js|css|mjs|cjs|html)$", r"\.(packed|bundle|chunk|umd|iife|prod)\.(js|css|mjs|cjs)$", r"\.(js|css|mjs|cjs|ts)\.map$", r"\.[0-9a-f]{8,}\.(chunk\.)?(js|css|mjs|cjs)$"))
DELIVERED_ENDINGS = ("js", "css", "mjs", "cjs", "html", "map")
#: Output folders of builds, told by two steps of the path or by a hashed name below them; only paths with one of the folders are compared.
BUILD_PATH = "|".join((r"(^|/)target/(debug|release)/", r"(^|/)(obj|bin)/(debug|release)/", r"(^|/)build/(generated|intermediates|outputs|assets/[^/]*-[a-z0-9_-]{8}\.(js|css|mjs)$)", r"(^|/)assets/[^/]*-(?=[^/]*[0-9])[a-z0-9_]{8}\.(js|css|mjs)$"))
BUILD_FOLDERS = ("target", "obj", "bin", "build", "assets")
#: First lines by which a tool says that it wrote the file.
HEADER = r"(?i)(@generated\b|\bcode generated\b.{0,80}\bdo not edit\b|\bauto-?generated (from|by)\b.{0,120}\b(do not|don't) (edit|modify|change)|\bfile (was|is) (written|produced|(automatically |auto-?)?generated) by\b.{0,120}\b(compiler|generator|changes will be lost|do not (edit|modify)))"

BIG = 1_000_000
#: Of several classes the last counts.
CLASSES = ("data", "generated", "minified", "vendored")
#: Lines of code in front of which a header may stand; comments, blank lines and imports don't count, however many.
HEAD_LINES = 12
#: How lines begin that stand in front of the code proper.
PREAMBLE = r"^(package|import|from|use|using|include|require|extern|namespace|module|pragma|syntax|option|edition|['\"]use |@charset|@import|@file)\b"
#: SHA-256 of nothing.
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
# How lines of comments begin; what opens and closes comments of several lines.
COMMENT_SIGNS = ("//", "#", "--", ";", "%", "*", "<?", "<!--", "/*", "(*", "{-", "\"\"\"", "'''")
COMMENT_BLOCKS = (("/*", "*/"), ("<!--", "-->"), ("(*", "*)"), ("{-", "-}"), ("\"\"\"", "\"\"\""), ("'''", "'''"))


def with_path_class(df: DataFrame, path: str, name: str) -> DataFrame:
    """Adds vendored, generated, minified or null, told by a normalised path alone.

    The parts of the path are columns of their own on the way, so each is worked out once a row.
    """
    kept = [F.col(c) for c in df.columns]
    low = df.select(*kept, F.lower(path).alias("_low"))
    steps = low.select(*kept, "_low", F.split("_low", "/").alias("_steps"))
    cut = steps.select(*kept, "_low", F.slice("_steps", 1, F.greatest(F.size("_steps") - 1, F.lit(0))).alias("_folders"), F.element_at("_steps", -1).alias("_name"))
    parts = cut.select("*", F.split("_name", "[._-]").alias("_parts"))
    among = lambda found, words: F.arrays_overlap(found, F.array(*map(F.lit, words)))
    told = (
        F.when(among("_folders", COPIES) | F.col("_low").rlike(VERSIONED), "vendored")
        .when(F.element_at("_parts", -1).isin(*DELIVERED_ENDINGS) & F.col("_name").rlike(DELIVERED_NAME), "minified")
        .when(among("_folders", WRITTEN) | (among("_parts", GENERATED_PARTS) & F.col("_name").rlike(GENERATED_NAME)) | (among("_folders", BUILD_FOLDERS) & F.col("_low").rlike(BUILD_PATH)), "generated")
    )
    return parts.select(*kept, told.alias(name))


def text_class(text: Column, path: Column) -> Column:
    """generated by its header, minified by its layout, or null, told by the whole text.

    A header stands in front of the code proper: before its first `HEAD_LINES` lines, which comments, blank lines and
    imports are not, however many there are. A text is squeezed if a script or style sheet has lines of
    500 characters on average, hardly a blank and names of one letter everywhere.
    """
    size = F.length(text)
    lines = size - F.length(F.translate(text, "\n\r", "")) + 1
    blanks = size - F.length(F.translate(text, " \t", ""))
    script = F.lower(path).rlike(r"\.(js|mjs|cjs|css|ts)$")
    single = F.regexp_count(text, F.lit(r"\b[a-zA-Z]\b"))
    squeezed = script & (size > 500) & (size / lines >= 500) & (blanks * 12 < size) & (single * 40 > size)
    return F.when(_may_have_header(text) & _head(text).rlike(HEADER), "generated").when(squeezed, "minified")


def _may_have_header(text: Column) -> Column:
    """Whether words of `HEADER` stand anywhere; few texts have any."""
    low = F.lower(text)
    out = low.contains("generated")
    for words in ("file was written", "file is written", "file was produced", "file is produced"):
        out = out | low.contains(words)
    return out


def _head(text: Column) -> Column:
    """The lines of a text up to the `HEAD_LINES`th of code. It is told line by line: a pattern over a long block would exhaust the stack."""
    lines = F.split(text, r"\r\n|\n|\r")

    def step(state: Column, raw: Column) -> Column:
        line = F.trim(F.translate(raw, "\t\ufeff", " "))
        free = (line == "") | line.rlike(PREAMBLE)
        for sign in COMMENT_SIGNS:
            free = free | line.startswith(sign)
        opened, closed = F.lit(0), F.lit(False)
        for i, (start, end) in enumerate(COMMENT_BLOCKS, 1):
            opened = F.when(line.startswith(start) & ~F.substring(line, len(start) + 1, 2_147_483_647).contains(end), i).otherwise(opened)
            closed = closed | ((state["block"] == i) & line.contains(end))
        inside = state["block"] > 0
        block = F.when(inside & ~closed, state["block"]).when(inside, 0).otherwise(opened)
        code = state["code"] + (~(inside | free)).cast("int")
        return F.struct(code.alias("code"), block.cast("int").alias("block"), (state["n"] + (code <= HEAD_LINES).cast("int")).alias("n"))

    start = F.struct(F.lit(0).alias("code"), F.lit(0).alias("block"), F.lit(0).alias("n"))
    leading = F.aggregate(lines, start, step, lambda state: state["n"])
    return F.array_join(F.slice(lines, F.lit(1), leading), "\n")


NODE = ("snapshot_id", "repository_id", "folder", "depth")

def _folded(rows: DataFrame) -> DataFrame:
    """One row a folder of a snapshot. The names in a folder differ, so the exclusive or of its children's hashes stands for their set; partial aggregation leaves one row a folder and task."""
    sums = [F.sum(c).alias(c) for c in ("files", "direct", "solid", "code")]
    return rows.groupBy(*NODE).agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"), *sums, F.min("first").alias("first"))


def _pair(*parts: Column | str) -> tuple[Column, Column]:
    """128 bits of hash in two numbers."""
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)


def merkle_folders(files: DataFrame) -> DataFrame:
    """A hash of every folder's tree in every repository: repository_id, folder ("" is the root), h1, h2, files (in the
    whole tree), direct (right in the folder), solid (files that are not empty), code (bytes of source files), first (when it came first).

    `files` has snapshot_id, repository_id, path, d1, d2 (the digest, hashed), solid, code, first, once per snapshot
    and path. Hashes of 128 bits are made bottom-up, one level of folders after the other: a folder's is
    that of the set of its children's names and hashes. There is one job a level, however deep; each
    reads only the folders of its level. A tree that recurs in snapshots of its repository comes once.
    """
    steps = F.split("path", "/")
    h1, h2 = _pair(F.element_at(steps, -1), "d1", "d2")
    folder = F.array_join(F.slice(steps, 1, F.size(steps) - 1), "/")
    own = files.select("snapshot_id", "repository_id", folder.alias("folder"), (F.size(steps) - 1).alias("depth"), h1.alias("h1"), h2.alias("h2"), F.lit(1).cast("long").alias("files"), F.lit(1).cast("long").alias("direct"), "solid", "code", "first")
    # Most folders hold few files, so folding these before they meet their sub-folders would shuffle nearly as much again.
    leaves = materialise(own, by=["depth"])
    levels, carried = [], None
    for level in range(leaves.agg(F.max("depth")).first()[0] or 0, -1, -1):
        here = leaves.where(F.col("depth") == level).select(*leaves.columns)
        nodes = materialise(_folded(here.unionByName(carried) if carried is not None else here))
        h1, h2 = _pair("h1", "h2", "files")
        levels.append(nodes.withColumns({"h1": h1, "h2": h2}))
        up1, up2 = _pair(F.substring_index("folder", "/", -1), "h1", "h2", "files")
        parent = F.when(F.col("folder").contains("/"), F.regexp_replace("folder", "/[^/]*$", "")).otherwise("")
        carried = nodes.select("snapshot_id", "repository_id", parent.alias("folder"), F.lit(level - 1).alias("depth"), up1.alias("h1"), up2.alias("h2"), "files", F.lit(0).cast("long").alias("direct"), "solid", "code", "first")
    found = leaves.limit(0)
    for nodes in levels:
        found = found.unionByName(nodes)
    return found.groupBy("repository_id", "folder", "h1", "h2", "files").agg(*(F.max(c).alias(c) for c in ("direct", "solid", "code")), F.min("first").alias("first"))


def copied_folders(trees: DataFrame, least_files: int = 3, least_code: int = 512, fork_share: float = 0.5) -> DataFrame:
    """Folders whose whole tree came first in an unrelated repository: repository_id, folder.

    Compared are trees of at least `least_files` files that are not empty, or with at least `least_code` bytes of
    source. Of the repositories that have a tree the one where it was delivered first is its
    origin (on equal times the one with more versions of that folder) and keeps it; in all others it is a
    copy, and in all of them where none was first. A repository that has more than `fork_share` of its files in folders that it shares,
    under equal paths, with the repository they came from is a fork of it and keeps these folders, but no others.
    """
    trees = materialise(trees)
    places = trees.where((F.col("solid") >= least_files) | (F.col("code") >= least_code))
    pair = places.groupBy("h1", "h2").agg(F.min("repository_id").alias("a"), F.max("repository_id").alias("b")).where("a <> b").select("h1", "h2")
    shared = materialise(lookup_join(places, pair, ["h1", "h2"], "left_semi", salt_on=["repository_id", "folder"]))
    if not measured(shared).rows:
        return shared.select("repository_id", "folder")
    versions = lookup_join(trees.select("repository_id", "folder"), shared.select("repository_id", "folder").distinct(), ["repository_id", "folder"], "left_semi", salt_on=["folder"]).groupBy("repository_id", "folder").agg((-F.count(F.lit(1))).alias("versions"))
    dated = lookup_join(shared, versions, ["repository_id", "folder"], salt_on=["h1"])
    # The first repository is the origin unless another is as old with as many versions; then none is.
    age = [F.col("first").isNull().alias("undated"), F.col("first"), F.col("versions")]
    alike = dated.groupBy("h1", "h2", *age).agg(F.min(F.struct("repository_id", "folder")).alias("a"), F.max(F.struct("repository_id", "folder")).alias("b"))
    origin = alike.groupBy("h1", "h2").agg(F.min(F.struct("undated", "first", "versions", "a", "b")).alias("o")).select("h1", "h2", "o.a", "o.b", (F.col("o.a.repository_id") == F.col("o.b.repository_id")).alias("known"))
    met = lookup_join(shared, origin, ["h1", "h2"], salt_on=["repository_id", "folder"]).withColumn("o", F.when(F.col("a.repository_id") == F.col("repository_id"), F.col("b")).otherwise(F.col("a")))
    copies = materialise(met.where("(not known or repository_id <> a.repository_id) and folder <> ''").select("repository_id", "folder", F.col("o.repository_id").alias("source"), (F.col("folder") == F.col("o.folder")).alias("same"), "direct"))
    weight = lambda rows, keys, name: rows.groupBy(*keys, "folder").agg(F.max("direct").alias("n")).groupBy(*keys).agg(F.sum("n").alias(name))
    common = weight(copies.where("same"), ["repository_id", "source"], "common")
    forks = lookup_join(common, weight(trees, ["repository_id"], "all"), ["repository_id"]).where(F.col("common") > fork_share * F.col("all")).select("repository_id", "source", F.lit(True).alias("same"))
    return lookup_join(copies, forks, ["repository_id", "source", "same"], "left_anti", salt_on=["folder"]).select("repository_id", "folder").distinct()


def foreign_files(manifest: DataFrame, snapshots: DataFrame, contents: DataFrame | None = None, big: int = BIG) -> DataFrame:
    """Files that are not hand-written source: snapshot_id, path, class; one row per snapshot and path.

    class is vendored (part of a third-party copy), generated, minified (or bundled) or data (a source
    file of `big` bytes or more). Four kinds of evidence are joined: the layout and names of the
    path; folders whose Merkle hash came first in an unrelated repository; the header and layout of
    the text, where `contents` has it; the size. What a text or size shows of a path in one snapshot
    holds for it in all snapshots of the worktree. A snapshot that has no row stands for itself.
    Rows without snapshot_id or path are left out; a missing repository is one of its own; null or
    senseless sizes show nothing. A path listed twice counts once: its row delivered last is part of the tree.
    """
    return evidence(manifest, snapshots, contents, big).select("snapshot_id", "path", "class")


def evidence(manifest: DataFrame, snapshots: DataFrame, contents: DataFrame | None = None, big: int = BIG) -> DataFrame:
    """As `foreign_files`, with what each piece of evidence tells, or null: by_path, by_file (text or size), by_tree.

    The manifest is read once, into a table with one row per snapshot and path, which is read three times: for the
    hashes, for what texts and sizes show, and for the result.
    """
    rows = manifest.select(
        norm_key("snapshot_id").alias("snapshot_id"), F.coalesce(norm_key("repository_id"), norm_key("snapshot_id")).alias("repository_id"),
        norm_path("path").alias("path"), compact_digest("sha256").alias("digest"), F.col("size_bytes").alias("size"), F.col("delivered_at").alias("came"),
    ).where("snapshot_id is not null and path is not null")
    worktrees = snapshots.select(norm_key("snapshot_id").alias("snapshot_id"), norm_key("worktree").alias("worktree")).where("snapshot_id is not null and worktree is not null").groupBy("snapshot_id").agg(F.min("worktree").alias("worktree"))
    rows = lookup_join(rows, worktrees, ["snapshot_id"], "left", salt_on=["path"])
    source = F.element_at(F.split(F.lower("path"), r"\."), -1).isin(*SOURCE)
    shown = F.when((F.col("size") >= big) & source, _rank(F.lit("data")))
    if contents is not None:
        # Few texts show anything; only their digests are looked up.
        texts = contents.where("sha256 is not null and content_text is not null").select(compact_digest("sha256").alias("digest"), _once_only(_rank(text_class(F.col("content_text"), norm_path(F.coalesce("path", F.lit(""))))), "told"))
        rows = lookup_join(rows, texts.groupBy("digest").agg(F.min("told").alias("told")), ["digest"], "left", salt_on=["path"])
        shown = F.coalesce("told", shown)
    d1, d2 = _pair("digest")
    sane = F.when(source & F.col("size").between(0, 1 << 40), F.col("size")).otherwise(0)
    last = F.max(F.struct("came", d1.alias("d1"), d2.alias("d2"), F.coalesce(F.hex("digest") != EMPTY.upper(), F.lit(True)).cast("long").alias("solid"), sane.alias("code")))
    once = rows.groupBy("snapshot_id", "path").agg(F.min("repository_id").alias("repository_id"), F.coalesce(F.min("worktree"), F.col("snapshot_id")).alias("worktree"), last.alias("last"), F.min("came").alias("first"), F.min(shown).alias("shown"))
    once = materialise(once.select("snapshot_id", "path", "repository_id", "worktree", "last.d1", "last.d2", "last.solid", "last.code", "first", "shown"))

    copied = materialise(copied_folders(merkle_folders(once)))
    shows = once.where("shown is not null").groupBy("worktree", "path").agg(F.min("shown").alias("by_file"))
    marked = lookup_join(once.select("snapshot_id", "repository_id", "worktree", "path"), shows, ["worktree", "path"], "left", salt_on=["snapshot_id"])
    by_tree = F.lit(None).cast("int")
    if measured(copied).rows:
        folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
        within = _below(once.select("repository_id", folder.alias("folder")).distinct(), copied)
        marked = lookup_join(marked.withColumn("folder", folder), within, ["repository_id", "folder"], "left", salt_on=["path"])
        by_tree = F.col("by_tree")
    told = with_path_class(marked.withColumn("by_tree", by_tree), "path", "by_path").withColumn("by_path", _rank(F.col("by_path")))
    # Numbers in place of words on the way; of several classes a copy counts first, then what the path tells.
    ranked = told.select("snapshot_id", "path", "by_path", "by_file", "by_tree", _once_only(F.coalesce("by_tree", "by_path", "by_file"), "rank"))
    word = lambda c: F.element_at(F.array(*map(F.lit, CLASSES)), F.col(c))
    return ranked.select("snapshot_id", "path", word("rank").alias("class"), *(F.when(F.col(c).isNotNull(), word(c)).alias(c) for c in ("by_path", "by_file", "by_tree")))


def _rank(word: Column) -> Column:
    """The place of a class in CLASSES, or null."""
    out = None
    for i, name in enumerate(CLASSES, 1):
        out = F.when(word == name, i) if out is None else out.when(word == name, i)
    return out


def _once_only(value: Column, name: str) -> Column:
    """Rows in which `value` is not null. A plain filter would work `value` out twice, before and after it."""
    return F.explode(F.array_compact(F.array(value))).alias(name)


def _below(folders: DataFrame, copied: DataFrame) -> DataFrame:
    """Of distinct folders those that lie in or are a copied one: repository_id, folder, by_tree."""
    steps = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    inner = folders.withColumn("above", F.explode(above))
    within = lookup_join(inner, copied.withColumnRenamed("folder", "above"), ["repository_id", "above"], "left_semi", salt_on=["folder"])
    return within.select("repository_id", "folder").distinct().withColumn("by_tree", _rank(F.lit("vendored")))
