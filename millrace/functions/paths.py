"""What a path says about a file, as columns and as SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, suffixes and markers that decide how a file is read.
LOCKFILES = (
    "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "bun.lock", "cargo.lock", "poetry.lock", "pipfile.lock", "uv.lock",
    "pdm.lock", "composer.lock", "gemfile.lock", "go.sum", "flake.lock", "packages.lock.json", "gradle.lockfile", "pubspec.lock", "podfile.lock",
)
MINIFIED = (".min.js", ".min.mjs", ".min.css", ".js.map", ".css.map")
GENERATED_PARTS = (".generated.", "_generated.")
GENERATED_ENDS = (".pb.go", "_pb2.py", "_pb2_grpc.py", ".g.dart")
GENERATED_HEADS = ("@generated", "do not edit", "code generated", "auto-generated", "autogenerated", "automatically generated")
TEST_PARTS = ("/test/", "/tests/", ".test.", ".spec.")
SOURCE_ENDS = ("rs", "js", "jsx", "ts", "tsx", "py", "java", "go", "c", "h", "cpp", "cs", "sql", "mjs", "cjs", "sh", "bash", "zsh", "bat", "cmd", "ps1")
LANGUAGES = {
    "rs": "rust", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "tsx", "py": "python", "java": "java",
    "go": "go", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp",
}
SKIPPED_PARTS = ("node_modules", "target", "dist", "build", ".git", ".local", "vendor", "__pycache__", ".venv")

#: Paths that meet every rule, for queries over tables without paths.
SAMPLE_PATHS = (
    "app/src/main.rs", "web/package-lock.json", "web/static/site.min.js", "api/user_pb2.py", "lib/schema.generated.ts", "docs/readme.md", "node_modules/x/index.js",
    "src/tests/unit.py", "src/login.spec.ts", ".env.local", "keys/server.pem", "Cargo.lock", "src/Engine.JAVA", "src/Engine.java", "noextension", "deep/build/out.c",
)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """What stands behind a name's last dot, if something stands before it."""
    return F.regexp_extract(file_name(path), r".\.([^.]*)$", 1)


def relative(path: Column, roots: list[str]) -> Column:
    """The shortest rest of a path below any root, else the path."""
    rests = F.array(path, *(F.when(path.startswith(r.rstrip("/") + "/"), F.substring(path, len(r.rstrip("/")) + 2, 1 << 30)).otherwise(path) for r in roots))
    return F.array_min(F.transform(rests, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]


def reading_exclusion(path: Column, head: Column) -> Column:
    """lockfile, minified or generated, the first that holds, else null."""
    name, low = F.lower(file_name(path)), F.lower(head)
    generated = any_of([name.contains(p) for p in GENERATED_PARTS] + [name.endswith(e) for e in GENERATED_ENDS] + [low.contains(m) for m in GENERATED_HEADS])
    return F.when(name.isin(*LOCKFILES), "lockfile").when(any_of([name.endswith(e) for e in MINIFIED]), "minified").when(generated, "generated")


def is_implementation(path: Column) -> Column:
    low = F.lower(path)
    return ~any_of([low.contains(p) for p in TEST_PARTS]) & extension(path).isin(*SOURCE_ENDS)


def language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.element_at(known, F.lower(extension(path))), F.lit("text"))


def is_skipped_by_default(path: Column) -> Column:
    name = file_name(path)
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIPPED_PARTS))) | name.startswith(".env") | name.endswith(".pem") | name.endswith(".key") | (name == "settings.enc")


def glob_regex(pattern: str) -> str:
    """A glob as a regex: ``**`` crosses directories, ``*`` and ``?`` do not."""
    out, at = "", 0
    while at < len(pattern):
        if pattern.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
        elif pattern.startswith("**", at):
            out, at = out + ".*", at + 2
        elif pattern[at] == "*":
            out, at = out + "[^/]*", at + 1
        elif pattern[at] == "?":
            out, at = out + "[^/]", at + 1
        else:
            out, at = out + ("\\" if pattern[at] in r"\.^$+{}()[]|" else "") + pattern[at], at + 1
    return f"^{out}$"


def matches_filters(path: Column, roots: list[str], include: list[str], exclude: list[str]) -> Column:
    """Whether a path, or what follows one of the roots in it, is included and not excluded; no include means all."""
    names = F.array(path, *(F.when(path.startswith(r.rstrip("/") + "/"), F.substring(path, len(r.rstrip("/")) + 2, 1 << 30)).otherwise(path) for r in roots))

    def meets(regex: str) -> Column:
        return F.exists(names, lambda n: n.rlike(regex))

    hit = lambda globs: any_of([meets(glob_regex(g)) for g in globs])
    included = hit(include) if include else F.lit(True)
    return included & ~hit(exclude) if exclude else included


_NAME = "lower(string_split(path, '/')[-1])"
_EXT = "regexp_extract(string_split(path, '/')[-1], '.\\.([^.]*)$', 1)"
_or = lambda parts: "(" + " OR ".join(parts) + ")"
_list = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"
EXCLUSION_SQL = (
    f"CASE WHEN {_NAME} IN {_list(LOCKFILES)} THEN 'lockfile' WHEN {_or([f'ends_with({_NAME}, {chr(39)}{e}{chr(39)})' for e in MINIFIED])} THEN 'minified' "
    f"WHEN {_or([f'contains({_NAME}, {chr(39)}{p}{chr(39)})' for p in GENERATED_PARTS] + [f'ends_with({_NAME}, {chr(39)}{e}{chr(39)})' for e in GENERATED_ENDS] + [f'contains(lower(left(text, 600)), {chr(39)}{m}{chr(39)})' for m in GENERATED_HEADS])} THEN 'generated' END"
)
IMPLEMENTATION_SQL = f"(NOT {_or([f'contains(lower(path), {chr(39)}{p}{chr(39)})' for p in TEST_PARTS])} AND {_EXT} IN {_list(SOURCE_ENDS)})"
LANGUAGE_SQL = f"CASE lower({_EXT}) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANGUAGES.items()) + " ELSE 'text' END"
SKIPPED_SQL = (
    f"(list_has_any(string_split(path, '/'), [{', '.join(repr(p) for p in SKIPPED_PARTS)}]) OR starts_with(string_split(path, '/')[-1], '.env') OR ends_with(path, '.pem') OR ends_with(path, '.key') OR string_split(path, '/')[-1] = 'settings.enc')"
)
