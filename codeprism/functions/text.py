"""Column functions over paths, symbols and text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: which paths are tests and evaluation harnesses
TEST_PATTERNS = (r"(?i)(^|/)(__tests__|tests?|specs?|benchmark)(/|$)", r"(?i)\.(test|spec)\.[cm]?[jt]sx?$", r"(^|/)\w+Tests?(/|$)", r"Tests?\.(swift|kt|java)$")
EVAL_PATTERNS = (r"(?i)(^|/)src/eval[^/]*\.ts$", r"(?i)(^|/)(benchmarks?|experiments|scripts)(/|$)")
# fixed values: languages that call one another form one family; any other extension is its own
FAMILIES = {"js_ts": (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"), "c_cpp": (".c", ".h", ".cpp", ".cc", ".cxx", ".hpp"), "python": (".py",), "go": (".go",), "rust": (".rs",), "java": (".java",), "json": (".json",)}
# fixed values: names that belong to a runtime, not to a project
BUILTINS = (
    "toString valueOf hasOwnProperty push pop shift unshift slice splice concat join map filter reduce forEach find findIndex some every includes indexOf lastIndexOf sort reverse flat flatMap keys values entries fill split trim trimStart trimEnd replace replaceAll match matchAll test exec padStart padEnd repeat charAt charCodeAt codePointAt startsWith endsWith toLowerCase toUpperCase substring substr localeCompare normalize"
    " get set has add delete clear trunc floor ceil round abs min max random pow sqrt log2 log10 sign now parse parseInt parseFloat isInteger isFinite isNaN toFixed toISOString then catch finally resolve reject all allSettled race any call apply bind"
    " JSON stringify Math Date Promise Array Object String Number Boolean Symbol RegExp Error TypeError RangeError Map Set WeakMap WeakSet Buffer URL URLSearchParams isArray from of assign freeze create getOwnPropertyNames fromEntries setTimeout setInterval clearTimeout clearInterval queueMicrotask structuredClone fetch console process require encodeURIComponent decodeURIComponent encodeURI decodeURI atob btoa"
    " warn info debug trace table dir group groupEnd assert time timeEnd"
).split()


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def is_test_path(path) -> Column:
    return any_of(F.col(path).rlike(p) for p in TEST_PATTERNS)


def is_eval_path(path) -> Column:
    return any_of(F.col(path).rlike(p) for p in EVAL_PATTERNS)


def extension(path) -> Column:
    """Lower-case extension with its dot, empty where there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def family(path) -> Column:
    """Language family of a path, null where the extension is unknown."""
    ext = extension(path)
    out = F.lit(None).cast("string")
    for name, exts in FAMILIES.items():
        out = F.when(ext.isin(*exts), name).otherwise(out)
    return out


def directory_bucket(rel, depth: int) -> Column:
    """The first ``depth`` directories of a relative path, ``.`` at the top."""
    parts = F.filter(F.split(rel, "/"), lambda x: x != "")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.when(F.size(dirs) == 0, ".").otherwise(F.array_join(F.slice(dirs, 1, depth), "/"))


def relative(path, root) -> Column:
    return F.when(F.col(path).startswith(F.concat(F.col(root), F.lit("/"))), F.substr(F.col(path), F.length(root) + 2)).otherwise(F.col(path))


def basename(path) -> Column:
    return F.substring_index(path, "/", -1)


def fnv1a(text) -> Column:
    """32-bit FNV-1a over the code points of a string, as a bigint."""
    points = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(points, F.lit(2166136261).cast("bigint"), lambda h, c: F.pmod(h.bitwiseXOR(F.ascii(c).cast("bigint")) * F.lit(16777619).cast("bigint"), F.lit(1 << 32)))


def token_estimate(text) -> Column:
    return F.ceil(F.length(text) / 4).cast("bigint")


def tokens(text) -> Column:
    """Lower-case words of ASCII letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), F.lit(1))


def complexity(code) -> Column:
    """One more than the branches and short-circuit operators in a piece of code, but for strings and slashed comments."""
    bare = F.regexp_replace(F.regexp_replace(code, r"\\.", ""), r"(?s)\"[^\"\n]*\"|'[^'\n]*'|//[^\n]*|/\*.*?\*/", " ")  # no groups are repeated, so the stack stays flat
    return F.lit(1) + F.regexp_count(bare, F.lit(r"\b(?:if|for|while|case|catch|except|elif)\b|&&|\|\||\?\?"))


# fixed values: what a query asks for, the first that matches
INTENTS = {"DEFINITION": "where is|what is|define", "FLOW": "how does|how is|implementation", "USAGE": "example|how to use|usage", "ARCHITECTURE": "architecture|system|overview"}


def agreed_intent(query: str) -> str:
    """DEFINITION, FLOW, USAGE, ARCHITECTURE or GENERAL, the first that matches."""
    import re

    for name, pattern in INTENTS.items():
        if re.search(pattern, query.lower()):
            return name
    return "GENERAL"


def is_symbol_query(query: str) -> bool:
    import re

    return re.fullmatch(r"[A-Za-z_$][A-Za-z0-9_$]*", query.strip(), re.A) is not None
