"""Surfaces of a repository: what kind of file a path names, as over fifty conditions over one string.

Each condition is written once against a vocabulary (`Place`); plans render the same vocabulary in SQL. Conditions
come in stages: later ones name earlier ones, so nothing is worked out twice in a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Endings of languages, the longer first.
LANGUAGES = (
    (".blade.php", "blade"), (".rs", "rust"), (".php", "php"), (".go", "go"), (".java", "java"), (".py", "python"), (".kt", "kotlin"), (".kts", "kotlin"), (".lua", "lua"),
    (".nims", "nim"), (".nim", "nim"), (".roc", "roc"), (".ts", "typescript"), (".tsx", "typescript"), (".js", "typescript"), (".jsx", "typescript"),
)
# Names of files, folders and words by which surfaces are told.
SCRIPT_ENDINGS = ("sh", "bash", "zsh", "fish", "bats", "ps1", "cmd", "bat", "nu")
SCRIPT_ENDINGS_JS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts")
TEST_WORDS = ("bench", "benchmark", "check", "e2e", "integration", "regression", "run", "smoke", "spec", "test", "unit")
HARNESSES = ("createsapplication.php", "dusktestcase.php", "pest.php", "testcase.php", "conftest.py")
RUST_CONFIG = ("cargo.toml", "cargo.lock", "rust-toolchain.toml", "rustfmt.toml", "clippy.toml")
LOCAL_CONFIG = (".env", ".env.example", ".luarc.json", ".luarc.jsonc", ".luarc.doc.json")
ANDROID_CONFIG = ("androidmanifest.xml", "build.gradle", "build.gradle.kts", "gradle.properties", "gradle-wrapper.properties", "init.gradle", "init.gradle.kts", "settings.gradle", "settings.gradle.kts")
MANIFESTS = ("pyproject.toml", "setup.py", "cargo.toml", "package.json", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "composer.json", "composer.lock", "tsconfig.json", "go.mod", "go.sum", "requirements.txt", "pipfile", "mix.exs")
PACKAGES = ("cargo.toml", "composer.json", "go.mod", "mix.exs", "package.json", "pyproject.toml", "setup.py")
WORKSPACE_FILES = ("pnpm-workspace.yaml", "turbo.json", "workspace.json", "nx.json", "tsconfig.json", "tsconfig.base.json")
ROOTED_CONFIG = (".cargo/config.toml", "gradle/init.gradle", "gradle/init.gradle.kts", "gradle/wrapper/gradle-wrapper.properties")
BUILD_FILES = ("build.rs", "build.gradle", "build.gradle.kts", "build.zig", "build.zig.zon", "dockerfile")
BUILD_STARTS = ("next.config.", "vite.config.", "vitest.config.", "jest.config.", "playwright.config.", "astro.config.")
DOC_NAMES = ("agents.md", "architecture.md", "changelog.md", "claude.md", "code_of_conduct.md", "contributing.md", "developers.md", "development.md", "examples.md", "faq.md", "index.md", "overview.md", "roadmap.md", "security.md", "support.md")
DOC_ENDINGS = ("adoc", "markdown", "md", "mdx", "rst", "txt")
DOC_FOLDERS = ("content", "doc", "docs", "documentation", "guide", "guides", "site", "website")
SITE_FOLDERS = ("doc", "docs", "documentation", "site", "website")
SITE_ENDINGS = ("cjs", "css", "js", "json", "jsx", "mdx", "mjs", "scss", "svg", "ts", "tsx")
WEB_FILES = ("openapi.json", "package-lock.json", "package.json", "pnpm-lock.yaml", "tsconfig.json", "yarn.lock")
NOISE_FILES = ("package-lock.json", "pnpm-lock.yaml", "yarn.lock", "openapi.json", "contributing.md", "claude.md", "hierarchy.md")
METADATA = (
    "agents.md", "architecture.md", "changelog.md", "claude.md", "composer.json", "contributing.md", "cargo.toml", "cargo.lock", "developers.md", "development.md", "package.json", "package-lock.json", "pnpm-lock.yaml",
    "pnpm-workspace.yaml", "yarn.lock", "pyproject.toml", "poetry.lock", "makefile", "justfile", "lerna.json", "nx.json", "security.md", "taskfile.yml", "taskfile.yaml", "turbo.json",
)
SERVICES = ("app", "bootstrap", "cli", "daemon", "main", "manage", "run", "server", "service", "worker")
LOADER_FOLDERS = ("bin", "cli", "cmd", "lua", "script", "scripts")
COMMAND_FOLDERS = ("bin", "cli", "cmd", "command", "commands")
NAVIGATION_WORDS = ("api", "client", "discoverer", "handler", "handlers", "protocol", "route", "router", "routes", "server", "transport")
WORKFLOW_WORDS = ("build", "bundle", "deploy", "pages", "publish", "release")
SUPPORT_WORDS = ("bench", "benches", "config", "configs", "fixture", "fixtures", "mock", "mocks", "spec", "specs", "stories", "story", "test", "tests")
PROVIDERS = ("appserviceprovider.php", "authserviceprovider.php", "broadcastserviceprovider.php", "configurationserviceprovider.php", "duskserviceprovider.php", "eventserviceprovider.php")
RUNTIME_ROOTS = ("app/", "bootstrap/", "routes/", "database/migrations/", "database/seeders/", "database/factories/")

#: What the conditions of a path are made of, worked out first: as written and in lower case (ASCII letters only).
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def facts(path: Column) -> dict[str, Column]:
    """The path without leading "./" in both spellings."""
    bare = F.regexp_replace(path, r"^(\./)+", "")
    return {"s_path": bare, "s_low": F.translate(bare, UPPER, LOWER)}


def parts(low: Column, cased: Column) -> dict[str, Column]:
    """Name, stem, ending (empty without one), steps, words of the stem and of the whole path."""
    name = F.substring_index(low, "/", -1)
    own = F.substring_index(cased, "/", -1)
    cut = lambda c: F.regexp_replace(c, r"(.)\.[^.]*$", "$1")
    words = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(F.regexp_replace(c, r"([a-z])([A-Z])", "$1 $2"), UPPER, LOWER), r"[^a-z0-9]+", " ")), F.lit(" "))
    return {"s_name": name, "s_stem": cut(name), "s_ext": F.regexp_extract(name, r".\.([^.]+)$", 1), "s_steps": F.concat(F.lit("/"), low, F.lit("/")), "s_words": words(cut(own)), "s_all_words": words(low)}


class Text(str):
    """A condition as text, joined as conditions are."""

    def __and__(self, other: str) -> Text:
        return Text(f"({self} AND {other})")

    def __or__(self, other: str) -> Text:
        return Text(f"({self} OR {other})")

    def __invert__(self) -> Text:
        return Text(f"(NOT {self})")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


class Place:
    """The vocabulary over the columns of `facts` and `parts`, as text of Spark; other dialects name two functions otherwise."""

    STARTS, ENDS = "startswith", "endswith"

    def ref(self, name: str) -> Text:
        return Text(name)

    def _any(self, tests: list) -> Text:
        return reduce(lambda a, b: a | b, tests)

    def _starts(self, column: str, text: str) -> Text:
        return Text(f"{self.STARTS}({column}, {_quoted(text)})")

    def _ends(self, column: str, text: str) -> Text:
        return Text(f"{self.ENDS}({column}, {_quoted(text)})")

    def _has(self, column: str, text: str) -> Text:
        return Text(f"contains({column}, {_quoted(text)})")

    def _among(self, column: str, values: tuple[str, ...]) -> Text:
        return Text(f"({column} IN ({', '.join(map(_quoted, values))}))")

    def choose(self, cases: list[tuple[Any, str]], otherwise: str | None) -> Text:
        return Text("CASE " + " ".join(f"WHEN {c} THEN {_quoted(v)}" for c, v in cases) + (f" ELSE {_quoted(otherwise)}" if otherwise is not None else "") + " END")

    def known(self, name: str) -> Text:
        return Text(f"({name} IS NOT NULL)")

    # The words below are made of those above.
    def path(self, *values: str, column: str = "s_low") -> Any:
        return self._among(column, values)

    def starts(self, *texts: str, column: str = "s_low") -> Any:
        return self._any([self._starts(column, t) for t in texts])

    def ends(self, *texts: str, column: str = "s_low") -> Any:
        return self._any([self._ends(column, t) for t in texts])

    def has(self, *texts: str, column: str = "s_low") -> Any:
        return self._any([self._has(column, t) for t in texts])

    def under(self, *folders: str, column: str = "s_low") -> Any:
        return self._any([self._starts(column, f + "/") | self._has(column, f"/{f}/") for f in folders])

    def name(self, *values: str) -> Any:
        return self._among("s_name", values)

    def stem(self, *values: str) -> Any:
        return self._among("s_stem", values)

    def ending(self, *values: str) -> Any:
        return self._among("s_ext", values)

    def step(self, *values: str) -> Any:
        return self._any([self._has("s_steps", f"/{v}/") for v in values])

    def word(self, *values: str, column: str = "s_words") -> Any:
        return self._any([self._has(column, f" {v} ") for v in values])

    def last_words(self, value: str) -> Any:
        return self._ends("s_words", f" {value} ")


def language_of(p: Any, column: str = "s_low") -> Any:
    return p.choose([(p.ends(e, column=column), n) for e, n in LANGUAGES], None)


def stage_one(p: Any) -> dict[str, Any]:
    """What needs the parts of the path alone."""
    config = (
        p.path(".cargo/config.toml") | p.ends("/.cargo/config.toml") | p.name(*RUST_CONFIG) | p.name(*LOCAL_CONFIG) | p.ends(".rockspec", ".nimble") | p.name(*ANDROID_CONFIG) | p.name(*MANIFESTS)
    )
    python_named = p.ending("py") & (p._starts("s_name", "test_") | p._ends("s_name", "_test.py"))
    return {
        "language": language_of(p),
        "path_class": p.choose(
            [
                (p._any([p._starts("s_path", f + "/") | p._has("s_path", f"/{f}/") | p._ends("s_path", "/" + f) | p._among("s_path", (f,)) for f in ("benches", "bench", "examples", "example", "tests", "test")]), "support"),
                ((p._ends("s_path", ".roc") & p.under("platform", column="s_path")) | p.starts(*RUNTIME_ROOTS, column="s_path"), "runtime"),
                (p._starts("s_path", "resources/views/"), "support"),
                (p.under("src", column="s_path") | p._ends("s_path", "/src") | p._among("s_path", ("src",)) | (~p._has("s_path", "/") & p.ends(*[e for e, _ in LANGUAGES], column="s_path")), "runtime"),
            ],
            "project",
        ),
        "is_runtime_config_artifact": config,
        "is_rust_workspace_config": p.path(".cargo/config.toml") | p.ends("/.cargo/config.toml") | p.name(*RUST_CONFIG),
        "is_python_runtime_config": p.name("pyproject.toml", "setup.py"),
        "is_package_surface": p.ends(".rockspec", ".nimble") | p.name(*PACKAGES),
        "is_build_config": p.path("justfile", "makefile") | p.name(*BUILD_FILES) | p._any([p._starts("s_name", t) for t in BUILD_STARTS]),
        "is_fixture_support": p.under("fixtures"),
        "is_example_support": p.under("examples", column="s_path"),
        "is_bench_support": p.under("benches", "bench", column="s_path"),
        "is_test_harness": p.name(*HARNESSES),
        "is_named_test_script": p.ending(*SCRIPT_ENDINGS) & (p.has("/scripts/") | p.word(*TEST_WORDS)),
        "is_python_named_test": python_named,
        "is_python_test_witness": p.ending("py") & (p.under("tests") | p.name("conftest.py") | python_named),
        "is_ci_workflow": p._starts("s_path", ".github/workflows/") & p.ends(".yml", ".yaml", column="s_path"),
        "is_readme": p._among("s_path", ("README.md",)) | p._ends("s_path", "/README.md"),
        "is_scripts_ops": p.path("justfile", "makefile") | p.starts("scripts/", "xtask/") | p.has("/scripts/"),
        "is_error_contract": p.under("contracts") & p.word("error", "errors", "failure", "failures"),
        "is_tool_contract": p.under("contracts/tools"),
        "is_repo_metadata": p.name(*METADATA),
        "is_frontend_noise": p.has("/frontend/") | (p.under("web") & (p.ending("css", "scss", "svg") | p.name(*WEB_FILES))) | (p.step(*SITE_FOLDERS) & p.ending(*SITE_ENDINGS)) | (p.step("registry", "template", "templates") & p.ending("js", "json", "jsx", "mjs", "ts", "tsx")) | p.name(*NOISE_FILES),
        "is_runtime_anchor_stem": p.stem("server", "discoverer"),
        "is_blade_view": p._starts("s_path", "resources/views/") & p._ends("s_path", ".blade.php"),
        "is_livewire_component": p.starts("app/Livewire/", "app/Http/Livewire/", column="s_path") & p._ends("s_path", ".php"),
        "is_command_or_middleware": p.starts("app/Console/Commands/", "app/Http/Middleware/", column="s_path") & p._ends("s_path", ".php"),
        "is_job_or_listener": p.starts("app/Jobs/", "app/Listeners/", "app/Events/", "app/Mail/", column="s_path") & p._ends("s_path", ".php"),
        "is_view_component_class": p._starts("s_path", "app/View/Components/") & p._ends("s_path", ".php"),
        "is_provider": p._starts("s_path", "app/Providers/") & p._ends("s_path", ".php"),
        "is_core_provider": p.name(*PROVIDERS),
        "is_route_file": p._starts("s_path", "routes/") & p._ends("s_path", ".php"),
        "is_bootstrap_entrypoint": p._among("s_path", ("bootstrap/app.php",)),
        "is_layout_view": p.starts("resources/views/") & p.ends(".blade.php") & (p.starts("resources/views/layouts/") | p.name("layout.blade.php")),
        "is_livewire_view": p._starts("s_path", "resources/views/livewire/") & p._ends("s_path", ".blade.php"),
        "is_blade_component": p._starts("s_path", "resources/views/") & p._ends("s_path", ".blade.php") & p.step("components"),
        "is_root_blade_component": p._starts("s_path", "resources/views/components/") & p._ends("s_path", ".blade.php"),
        "is_form_action_view": p.starts("resources/views/") & p.ends(".blade.php") & p.has("/forms/", "/partials/", "/modals/"),
        "is_migration": p._starts("s_path", "database/migrations/"),
    }


def stage_two(p: Any) -> dict[str, Any]:
    r = p.ref
    test = ~r("is_runtime_config_artifact") & ~r("is_fixture_support") & ((p.under("tests", "test") & (p.known("language") | r("is_named_test_script") | r("is_test_harness"))) | p.ends("_test.go", "_test.rs", "_tests.rs") | r("is_python_named_test"))
    return {
        "is_test_support": test,
        "is_root_scoped_config": r("is_runtime_config_artifact") & (~p.has("/") | p.path(*ROOTED_CONFIG)),
        "is_runtime_doc": r("is_readme") | p.name(*DOC_NAMES) | (p.ending(*DOC_ENDINGS) & p.step(*DOC_FOLDERS)),
        "is_loose_python_test": p.ending("py") & ~r("is_python_test_witness") & p.under("test"),
        "is_runtime_adjacent_python_test": r("is_python_test_witness") & ~p.under("tests", "test"),
        "is_build_workflow": r("is_ci_workflow") & p.word(*WORKFLOW_WORDS),
        "is_nested_blade_component": r("is_blade_component") & ~r("is_root_blade_component"),
        "is_plain_blade_view": r("is_blade_view") & ~r("is_livewire_view") & ~r("is_blade_component"),
        "is_navigation_runtime": p._among("path_class", ("runtime", "support")) & p.word(*NAVIGATION_WORDS),
    }


def stage_three(p: Any) -> dict[str, Any]:
    r = p.ref
    free = ~r("is_test_support")
    script = p.ending(*SCRIPT_ENDINGS_JS)
    tree = p._among("path_class", ("runtime",)) | p.under("app") | p.has("/lib/")
    main_tree = free & p.ending("java", "kt") & p.under("src/main")
    lua = free & p.ending("lua") & (
        (~p.has("/") & p.stem("main", "init", "app", "bootstrap", "cli", "run", "server"))
        | (p.under(*LOADER_FOLDERS) & (p.step("cli", "command", "commands") | (p.step("daemon", "server", "service", "worker") & p.stem("bootstrap", "cli", "daemon", "init", "main", "run", "server", "service"))))
    )
    typescript = free & script & (p.stem("main", "server", "cli", "app", "bootstrap") | (tree & p.stem("index") & (p._any([p.path(f"src/index.{e}") | p.ends(f"/src/index.{e}") for e in SCRIPT_ENDINGS_JS])) & p.word("app", "bootstrap", "cli", "daemon", "server", "service", "worker", column="s_all_words")))
    entry = (
        p._among("s_path", ("src/main.rs", "src/lib.rs")) | p.ends("/src/main.rs", "/src/lib.rs", column="s_path")
        | (p.ending("go") & free & (p.name("main.go") | (p.under("cmd") & p.name("root.go"))))
        | (main_tree & (p.word("activity", "application", "navigation") | p.word("nav graph")))
        | (p.ending("roc") & free & (p.path("main.roc", "platform/main.roc") | p.ends("/platform/main.roc")))
        | lua | p.name("__main__.py", "main.py", "app.py", "manage.py", "cli.py", "run.py") | typescript
    )
    source = p.choose(
        [
            (r("is_error_contract"), "error_contracts"), (r("is_tool_contract"), "tool_contracts"), (p._starts("s_path", "benchmarks/"), "benchmark_docs"), (r("is_readme"), "readme"),
            (p._starts("s_path", "docs/"), "documentation"), (r("is_fixture_support"), "fixtures"), (r("is_ci_workflow"), "support"), (p._starts("s_path", "specs/"), "specs"), (r("is_test_support"), "tests"),
            (p._among("path_class", ("support",)), "support"), (p._among("path_class", ("runtime",)), "runtime"),
        ],
        "project",
    )
    return {
        "is_entrypoint": entry,
        "source_class": source,
        "is_workspace_config": r("is_root_scoped_config") | p.name(*WORKSPACE_FILES),
        "is_android_screen": main_tree & (p.last_words("screen") | p.last_words("view model")),
        "is_module_index": free & ~r("is_example_support") & ~r("is_bench_support") & script & tree & p.stem("index") & ~p.word(*SUPPORT_WORDS, column="s_all_words"),
        "is_cli_test": r("is_test_support") & (p.under("cli") | p.ends("/cli.rs")),
        "is_runtime_anchor_test": r("is_test_support") & p._any([p.stem(s, f"{s}_test", f"{s}_tests", f"test_{s}", f"tests_{s}", f"{s}-test", f"{s}.test", f"{s}.spec", f"{s}test") for s in SERVICES]),
        "is_non_code_test_doc": r("is_test_support") & p.ending("md", "markdown", "rst", "txt", "adoc"),
        "is_non_prefix_python_test": r("is_loose_python_test") | p._ends("s_name", "_test.py"),
    }


def stage_four(p: Any) -> dict[str, Any]:
    r = p.ref
    taken = ("is_entrypoint", "is_runtime_config_artifact", "is_package_surface", "is_build_config", "is_workspace_config", "is_test_support", "is_test_harness", "is_fixture_support", "is_example_support", "is_bench_support", "is_runtime_doc", "is_ci_workflow", "is_scripts_ops", "is_frontend_noise")
    return {
        "is_runtime_companion": p._among("source_class", ("runtime",)) & ~p._any([r(n) for n in taken]),
        "is_cli_command_entrypoint": r("is_entrypoint") & (p.stem("cli") | p.under(*COMMAND_FOLDERS)),
        "is_navigation_reference_doc": p._among("source_class", ("documentation", "readme", "specs")),
        "is_entrypoint_reference_doc": p._starts("s_path", "specs/") | p._among("source_class", ("documentation",)),
    }


STAGES = (stage_one, stage_two, stage_three, stage_four)
PARTS = ("s_path", "s_low", "s_name", "s_stem", "s_ext", "s_steps", "s_words", "s_all_words")


def names() -> list[str]:
    """All surfaces, with language, path_class and source_class among them; needs no session."""
    return [n for stage in STAGES for n in stage(Place())]


def needed(wanted: Iterable[str]) -> list[dict[str, Text]]:
    """Of each stage the conditions that `wanted` are made of."""
    stages, left = [stage(Place()) for stage in STAGES], set(wanted)
    out: list[dict[str, Text]] = []
    for stage in reversed(stages):
        kept = {n: c for n, c in stage.items() if n in left}
        left |= {word for c in kept.values() for word in re.findall(r"[a-z_]+", re.sub(r"'[^']*'", "", c))}
        out.insert(0, kept)
    return out


def with_facts(paths: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later filters can't be pushed through: each is worked out once a row, behind any aggregation before."""
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_facts")
    return paths.select("*", one).select(*paths.columns, *[F.col("_facts." + n).alias(n) for n in columns])


def with_surfaces(paths: DataFrame, *wanted: str, path: str = "path") -> DataFrame:
    """Adds the surfaces named (all by default) of a column of paths. Null paths have null surfaces but for the classes, which are those of no folder."""
    kept = paths.columns
    out = with_facts(paths, **facts(F.col(path)))
    out = with_facts(out, **parts(F.col("s_low"), F.col("s_path")))
    for stage in needed(wanted or names()):
        if stage:
            out = with_facts(out, **{n: F.expr(c) for n, c in stage.items()})
    return out.select(*kept, *(wanted or names()))
