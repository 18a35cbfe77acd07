"""The search tools over one corpus of files: repository_id, path, text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.intent import read_query
from corvane.operators import paths, ranking, symbols, text
from corvane.operators.surfaces import with_surfaces
from corvane.tables import norm_path

MAX_RESULTS = 200


class Corpus:
    """Files with their texts; every method returns a DataFrame in a total order, at most MAX_RESULTS rows where it is a search."""

    def __init__(self, files: DataFrame) -> None:
        self.files = files.select("repository_id", norm_path("path").alias("path"), "text").where("path is not null")
        self._keys = ["repository_id", "path"]

    def restricted(self, repository: str | None = None, language: str | None = None, path_regex: str | None = None) -> Corpus:
        """The same tools over some of the files; filters reach the scan before any text is read."""
        files = self.files
        if repository is not None:
            files = files.where(F.col("repository_id") == repository)
        if language is not None:
            if language not in {name for _, name in paths.LANGUAGES}:
                raise ValueError(f"unknown language {language}")
            files = files.where(paths.language(F.lower("path")) == language)
        if path_regex is not None:
            text.check_pattern(path_regex)
            files = files.where(F.col("path").rlike(path_regex))
        return Corpus(files)

    def search_text(self, query: str, regex: bool = False, limit: int = 100, per_file: int | None = None) -> DataFrame:
        """repository_id, path, line, column, excerpt (or matched)."""
        if not query.strip():
            raise ValueError("empty query")
        hits = text.regex_matches(self.files, self._keys, "text", query) if regex else text.literal_matches(self.files, self._keys, "text", query)
        if per_file is not None:
            hits = text.cap_per_key(hits, self._keys, ["line", "column"], per_file)
        return hits.orderBy(*self._keys, "line", "column").limit(min(limit, MAX_RESULTS))

    def explore(self, path: str, query: str, cursor: tuple[int, int] | None = None, limit: int = 8) -> DataFrame:
        """Matches in one file, a page at a time: line, column, resume."""
        hits = text.literal_matches(self.files.where(F.col("path") == path), self._keys, "text", query).select("line", "column")
        return text.page_after(hits, ["line", "column"], cursor, limit)

    def read_file(self, path: str, first: int = 1, last: int = 200, max_bytes: int = 65_536) -> DataFrame:
        return text.slice_lines(self.files.where(F.col("path") == path), self._keys, "text", first, last, max_bytes)

    def _code(self) -> DataFrame:
        key = F.concat_ws(":", "repository_id", "path")
        return text.lines(self.files.select(key.alias("file"), "text"), ["file"], "text")

    def _spans(self) -> DataFrame:
        return symbols.symbols(self.files.select(F.concat_ws(":", "repository_id", "path").alias("file"), "text"))

    def search_symbol(self, query: str, limit: int = 50, path_class: str | None = None) -> DataFrame:
        """file, name, canonical, kind, start_line, rank; `path_class` (runtime, support or project) restricts the files."""
        corpus = self if path_class is None else Corpus(with_surfaces(self.files, "path_class").where(F.col("path_class") == path_class))
        return symbols.search_symbols(corpus._spans(), query, min(limit, MAX_RESULTS))

    def document_symbols(self, path: str) -> DataFrame:
        """The symbol tree of a file."""
        return symbols.outline_rows(Corpus(self.files.where(F.col("path") == path))._spans()).orderBy("file", "place")

    def find_references(self, name: str, limit: int = 100) -> DataFrame:
        """Lines that hold the name as a whole word: file, line, is_definition."""
        code = self._code().where(F.contains("body", F.lit(name)))
        whole = code.where(F.array_contains(F.transform(F.regexp_extract_all("body", F.lit(symbols.WORD), 1), lambda w: F.rtrim(w, F.lit("("))), name))
        declared = (F.regexp_extract("body", symbols.DECLARATION, 2) == name) | (F.regexp_extract("body", symbols.METHOD, 1) == name)
        return whole.select("file", "line", declared.alias("is_definition")).orderBy("file", "line").limit(min(limit, MAX_RESULTS))

    def go_to_definition(self, name: str) -> DataFrame:
        return self._spans().where(F.col("name") == name).select("file", "kind", "name", "container", "start_line", "end_line").orderBy("file", "start_line")

    def outgoing_calls(self, name: str) -> DataFrame:
        return symbols.calls(self._code(), self._spans()).where(F.col("caller") == name).orderBy("file", "callee")

    def incoming_calls(self, name: str) -> DataFrame:
        return symbols.calls(self._code(), self._spans()).where(F.col("callee") == name).orderBy("file", "caller")

    def search_hybrid(self, query: str, limit: int = 16) -> DataFrame:
        """Documents by fused evidence of text, path and shared terms: document, path, score, line, anchors, sources."""
        intent = read_query(query, limit)
        terms = list(intent.terms) or [query]
        document = F.concat_ws(":", "repository_id", "path")
        recall = text.lines(self.files.select(document.alias("document"), "text"), ["document"], "text").where(F.col("body").rlike(text.term_pattern(terms)))
        hit = F.lit(0)
        for t in terms:
            hit = hit + F.contains(F.lower("body"), F.lit(t)).cast("int")
        scored = recall.withColumn("hits", hit)
        frequency = scored.groupBy("document").agg(F.count(F.lit(1)).alias("n"), F.max("hits").alias("most"), F.min(F.struct((-F.col("hits")).alias("h"), "line")).alias("at"))
        lexical = scored.join(frequency.select("document", "n"), "document").select("document", "line", F.lit("lexical").alias("channel"), (F.sqrt("n") * F.col("hits")).alias("raw_score"), F.col("body").alias("excerpt"))
        semantic = frequency.select("document", F.col("at.line").alias("line"), F.lit("semantic").alias("channel"), (F.col("most") / len(terms)).alias("raw_score"), F.lit("").alias("excerpt"))
        shared = F.size(F.array_intersect(paths.path_terms(F.col("path")), F.array(*map(F.lit, terms))))
        rules = [r for r, wanted in ((ranking.Rule("readme", factor=1.45, all_of=("is_readme",)), "docs"), (ranking.Rule("tests", factor=1.24, all_of=("is_test_support",)), "tests"), (ranking.Rule("config", factor=1.4, all_of=("is_runtime_config_artifact",)), "config"), (ranking.Rule("workflow", factor=2.2, all_of=("is_build_workflow",)), "ci")) if wanted in intent.flags]
        named = [n for r in rules for n in r.all_of]
        quality, _ = ranking.apply_rules(F.lit(1.0), rules, {n: F.col(n) for n in named})
        witness = (with_surfaces(self.files, *named) if named else self.files).select(document.alias("document"), F.lit(1).alias("line"), F.lit("witness").alias("channel"), (shared * quality).alias("raw_score"), F.col("path").alias("excerpt")).where("raw_score > 0")
        blended = ranking.blend(ranking.normalise(lexical.unionByName(semantic).unionByName(witness)))
        return ranking.roll_up(blended).orderBy(F.col("score").desc(), "document").limit(min(limit, MAX_RESULTS))
