"""Scalar functions on text and paths, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language of each file extension, extensions of binary files, and
# names of files that are code whatever their extension.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "pyi": "python",
    "pyw": "python", "java": "java", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "groovy": "groovy", "gradle": "groovy", "c": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "h": "c", "hpp": "cpp", "hxx": "cpp", "cs": "csharp", "fs": "fsharp",
    "vb": "vb", "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "pl": "perl", "pm": "perl", "lua": "lua",
    "r": "r", "swift": "swift", "m": "objectivec", "mm": "objectivec", "sh": "shell", "bash": "shell", "zsh": "shell", "fish": "shell",
    "ps1": "powershell", "psm1": "powershell", "bat": "batch", "cmd": "batch", "html": "html", "htm": "html", "css": "css", "scss": "scss",
    "sass": "sass", "less": "less", "vue": "vue", "svelte": "svelte", "astro": "astro", "json": "json", "jsonc": "json", "json5": "json",
    "yaml": "yaml", "yml": "yaml", "toml": "toml", "xml": "xml", "ini": "ini", "cfg": "ini", "conf": "ini", "properties": "properties",
    "env": "dotenv", "md": "markdown", "mdx": "markdown", "rst": "rst", "txt": "text", "sql": "sql", "prisma": "prisma", "graphql": "graphql",
    "gql": "graphql", "dockerfile": "dockerfile", "tf": "terraform", "hcl": "hcl", "proto": "protobuf", "sol": "solidity", "zig": "zig", "nim": "nim",
    "ex": "elixir", "exs": "elixir", "erl": "erlang", "hrl": "erlang", "clj": "clojure", "cljs": "clojure", "cljc": "clojure", "hs": "haskell",
    "elm": "elm", "dart": "dart", "v": "v", "asm": "assembly", "s": "assembly",
}
BINARY = [
    "exe", "dll", "so", "dylib", "bin", "pdf", "jpg", "jpeg", "png", "gif", "svg", "ico", "mp3", "mp4", "avi", "mov", "wav", "zip", "tar", "gz", "rar", "7z", "db", "sqlite", "sqlite3", "woff", "woff2", "ttf", "eot", "pyc", "class", "o", "a",
]
CODE_NAMES = [
    "Makefile", "Dockerfile", "Jenkinsfile", "Vagrantfile", "Rakefile", "Gemfile", "Podfile", "Fastfile", "CMakeLists.txt", "meson.build", "BUILD", "WORKSPACE",
    ".gitignore", ".gitattributes", ".dockerignore", ".editorconfig", ".prettierrc", ".eslintrc", ".babelrc", ".browserslistrc",
    "tsconfig.json", "jsconfig.json", "package.json", "angular.json", "nest-cli.json", "nx.json", "webpack.config.js", "vite.config.js", "rollup.config.js",
    ".gitlab-ci.yml", ".travis.yml", "azure-pipelines.yml", "bitbucket-pipelines.yml", "cloudbuild.yaml", "Chart.yaml", "values.yaml", "kustomization.yaml",
]


def normalize_text(x: Column) -> Column:
    """Lower case, trimmed, runs of white space as one space."""
    return F.regexp_replace(F.trim(F.lower(x)), r"(?U)\s+", " ")


def text_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length of the normalised texts; 1 if both are
    empty, 0 if one is."""
    x, y = normalize_text(a), normalize_text(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, F.lit(1.0)).when((F.length(x) == 0) | (F.length(y) == 0), F.lit(0.0)).otherwise(1 - F.levenshtein(x, y) / longest)


def nearly_same(x: Column, y: Column, least: float) -> Column:
    """text_similarity >= least for texts that are normalised already; the edit
    distance stops where it can't hold any more."""
    longest, shortest = F.greatest(F.length(x), F.length(y)), F.least(F.length(x), F.length(y))
    most = F.floor((1 - least) * longest + 1e-9).cast("int")
    return F.when(longest == 0, F.lit(least <= 1)).when(shortest == 0, F.lit(least <= 0)).when(longest - shortest > most, False).otherwise(F.call_function("levenshtein", x, y, most) >= 0)


def token_count(x: Column) -> Column:
    """A token for four characters, rounded up."""
    return F.ceil(F.length(x) / 4).cast("long")


def chunk_id(path: Column, start_line: Column, content: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", path, start_line.cast("string"), content), 256), 1, 16)


def extension(path: Column) -> Column:
    """Lower-cased extension without its dot; '' if there is none."""
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"[^/]\.([^./]+)$", 1))


def language(path: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("unknown"))


def is_binary_file(path: Column) -> Column:
    return extension(path).isin(*BINARY)


def is_code_file(path: Column) -> Column:
    """Whether a file is indexed: by its extension, or by its name."""
    return ~is_binary_file(path) & (extension(path).isin(*LANGUAGES) | F.substring_index(path, "/", -1).isin(*CODE_NAMES))


def document_name(name: Column) -> Column:
    """A document as it is asked for: lower case, without .md and the first underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"\.md", ""), "^([^_]*)_", "$1")


def age_text(since: Column, now: Column) -> Column:
    """How long ago, in whole minutes below an hour and in whole hours above."""
    minutes = F.floor((F.unix_millis(now.cast("timestamp")) - F.unix_millis(since.cast("timestamp"))) / 60000)
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" minute(s) ago"))).otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit(" hour(s) ago")))


def time_of_day(at: Column) -> Column:
    """Hours, minutes and seconds of a time."""
    return F.date_format(at.cast("timestamp"), "HH:mm:ss")


def task_id(at: Column, external: bool = False) -> Column:
    """A prefix and the last six digits of the milliseconds of a time."""
    return F.concat(F.lit("EXT-" if external else "TASK-"), F.lpad(F.pmod(F.unix_millis(at.cast("timestamp")), F.lit(1_000_000)).cast("string"), 6, "0"))


def contains_all(text: Column, words: list[str]) -> Column:
    """Whether the normalised text holds every normalised word."""
    low = normalize_text(text)
    out = F.lit(True)
    for word in words:
        out = out & F.contains(low, normalize_text(F.lit(word)))
    return out


def slug(name: Column) -> Column:
    """Project id of a folder name; 'default' if nothing is left."""
    x = F.regexp_replace(F.lower(F.substring_index(name, "/", -1)), "[^a-z0-9_-]", "-")
    x = F.regexp_replace(F.regexp_replace(x, "-+", "-"), "^-|-$", "")
    return F.when(x == "", "default").otherwise(x)


def preview(text: Column) -> Column:
    """Non-blank lines 2 to 6."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x) != "")
    return F.array_join(F.slice(lines, 2, 5), "\n")


def line_slice(text: Column, first: int, last: int) -> Column:
    """Lines first..last, 1-based and inclusive."""
    return F.array_join(F.slice(F.split(text, "\n", -1), max(first, 1), max(0, last - max(first, 1) + 1)), "\n")
