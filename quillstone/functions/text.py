"""Text functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

ALNUM = r"\p{IsAlphabetic}\p{N}"


def query_tokens(query: Column) -> Column:
    """Runs of letters, digits, `_` and `:` of at least two bytes."""
    return F.filter(F.split(query, f"[^{ALNUM}_:]+"), lambda t: F.octet_length(t) >= 2)


def has_inner_uppercase(token: Column) -> Column:
    return token.rlike(r"(?s)^\p{Ll}.*\p{Lu}")


def route_query(query: Column) -> Column:
    """struct(dense_weight, lexical_weight, natural_language): short and identifier-like queries lean lexical."""
    tokens = query_tokens(query)
    n = F.size(tokens)
    identifier = F.exists(tokens, lambda t: t.contains("_") | t.contains("::") | has_inner_uppercase(t))
    lexical = (n <= 3) | (identifier & (n <= 6))
    of = lambda w, nl: F.struct(F.lit(w[0]).alias("dense_weight"), F.lit(w[1]).alias("lexical_weight"), F.lit(nl).alias("natural_language"))
    return F.when(lexical, of(K.LEXICAL_ROUTE, False)).otherwise(of(K.NATURAL_ROUTE, True))


def subtokens(identifier: Column) -> Column:
    """Parts at non-alphanumerics and before each capital, in ASCII lower case."""
    parts = F.split(F.regexp_replace(identifier, r"(\p{Lu})", " $1"), f"[^{ALNUM}]+")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.translate(p, upper, upper.lower()))


def tokens_match(a: Column, b: Column) -> Column:
    """Equal, or one begins the other and both have at least four bytes."""
    return (a == b) | ((F.least(F.octet_length(a), F.octet_length(b)) >= 4) & (F.startswith(a, b) | F.startswith(b, a)))


def fts_query(query: Column, expansions: Column | None = None) -> Column:
    """The first tokens quoted, those of four bytes or more as prefixes, and quoted expansions, joined by OR."""
    quote = lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))
    terms = F.transform(F.slice(query_tokens(query), 1, K.MAX_QUERY_TERMS), lambda t: F.concat(quote(t), F.when(F.octet_length(t) >= 4, "*").otherwise("")))
    own = F.coalesce(expansions, F.array().cast("array<string>")) if expansions is not None else F.array().cast("array<string>")
    return F.array_join(F.concat(terms, F.transform(own, quote)), " OR ")


def word_set(text: Column) -> Column:
    """Distinct lower-case words of at least two bytes."""
    return F.array_distinct(F.transform(F.filter(F.split(text, f"[^{ALNUM}]+"), lambda t: F.octet_length(t) >= 2), lambda t: F.lower(t)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets; two empty sets are equal."""
    return F.when(F.size(F.array_union(a, b)) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)))


def index_terms(text: Column) -> Column:
    """Terms of the inverted index: letters and digits, lower case, accents removed."""
    accents, plain = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
    return F.filter(F.split(F.translate(F.lower(text), accents, plain), f"[^{ALNUM}]+"), lambda t: t != "")


def is_generated(content: Column) -> Column:
    return F.exists(F.slice(F.split(content, "\n"), 1, K.GENERATED_LINES), lambda x: x.contains(K.GENERATED_MARK))


def language_of(relpath: Column) -> Column:
    """Language by the extension, which is case-sensitive; null if unknown."""
    pairs = F.create_map(*[F.lit(x) for kv in K.LANGUAGES.items() for x in kv])
    return F.element_at(pairs, F.regexp_extract(relpath, r"\.([^./]*)$", 1))


def repo_key(url: Column) -> Column:
    """host/path of a remote: no scheme, credentials, port or .git; only the host in lower case; null if incomplete."""
    u = F.regexp_replace(F.trim(url), "/+$", "")
    with_scheme = u.contains("://")
    rest = F.when(with_scheme, F.regexp_extract(u, "(?s)://(.*)$", 1)).otherwise(u)
    host = F.when(with_scheme, F.substring_index(rest, "/", 1)).when(rest.contains(":"), F.substring_index(rest, ":", 1))
    path = F.when(with_scheme, F.regexp_extract(rest, "(?s)^[^/]*/(.*)$", 1)).otherwise(F.regexp_extract(rest, "(?s)^[^:]*:(.*)$", 1))
    host = F.lower(F.regexp_replace(F.substring_index(host, "@", -1), ":[0-9]*$", ""))
    path = F.regexp_replace(F.regexp_replace(path, "^/+", ""), r"\.git$", "")
    return F.when((host != "") & (path != ""), F.concat(host, F.lit("/"), path))


def path_scope_key(path: Column, home: Column) -> Column:
    """path:~, path:~/rel or path:/abs, by whole path components."""
    inside = F.startswith(path, F.concat(home, F.lit("/")))
    return F.when(path == home, F.lit("path:~")).when(inside, F.concat(F.lit("path:~/"), F.substring(path, F.length(home) + 2, F.length(path)))).otherwise(F.concat(F.lit("path:"), path))


def byte_size(text: Column) -> Column:
    """Bytes of `512kb`, `1MB`, `7`; null if malformed."""
    n, unit = F.regexp_extract(F.trim(text), r"^(?i)([0-9]+)\s*(b|kb|mb|gb|k|m|g)?$", 1), F.lower(F.regexp_extract(F.trim(text), r"^(?i)([0-9]+)\s*(b|kb|mb|gb|k|m|g)?$", 2))
    scale = F.when(unit.startswith("k"), 1 << 10).when(unit.startswith("m"), 1 << 20).when(unit.startswith("g"), 1 << 30).otherwise(1)
    return F.when(n != "", F.expr("1") * n.cast("long") * scale)


def parse_anchor(spec: Column) -> Column:
    """struct(relpath, start_line, end_line) of `path`, `path:7` or `path:7-9`."""
    ranged = spec.rlike(r"^.+:[0-9]+(-[0-9]+)?$")
    part = lambda i: F.regexp_extract(spec, r"^(.+):([0-9]+)(?:-([0-9]+))?$", i)
    number = lambda i: F.when(ranged & (part(i) != ""), part(i).cast("int"))
    return F.struct(F.when(ranged, part(1)).otherwise(spec).alias("relpath"), number(2).alias("start_line"), F.coalesce(number(3), number(2)).alias("end_line"))


def render_prompt(template: str, **values: Column) -> Column:
    """A template with {name} places, filled in one pass: what is put in is not searched again."""
    import re

    parts = re.split("(" + "|".join("\\{" + n + "\\}" for n in values) + ")", template)
    return F.concat(*[F.coalesce(values[p[1:-1]], F.lit("")) if p[1:-1] in values and p.startswith("{") else F.lit(p) for p in parts if p])


def format_hit(relpath: Column, start: Column, end: Column, score: Column, key: Column | None = None) -> Column:
    """path:a-b (NN.NN% match), after the repository's key if given."""
    line = F.format_string("%s:%d-%d (%.2f%% match)", relpath, start, end, score * 100)
    return F.concat_ws("/", key, line) if key is not None else line


def escape_field(text: Column, in_list: bool = False) -> Column:
    """A field of a tab-separated line; commas are escaped within lists."""
    for raw, code in (("\\", "\\\\"), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r"), *((((",", "\\,"),)) if in_list else ())):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape_field(text: Column) -> Column:
    def part(p: Column) -> Column:
        for raw, code in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r"), (",", "\\,")):
            p = F.replace(p, F.lit(code), F.lit(raw))
        return p

    return F.array_join(F.transform(F.split(text, r"\\\\"), part), "\\")


def normalize_citations(text: Column) -> Column:
    """`Source 2`, `(Source 2)`, `[Source 1, Source 2]` become `[2]`, `[1], [2]`."""
    item = r"(?:Source )?([0-9]+)"
    out = F.regexp_replace(text, r"[\[(](Source [0-9]+(?:(?:, and |, | and |; )(?:Source )?[0-9]+)*)[\])]", "\u0001$1\u0002")
    out = F.regexp_replace(out, r"(?<=[0-9])(?:, and | and |; |, )(?=(?:Source )?[0-9]+[^\u0001]*\u0002)", ", ")
    # Inside marked groups and outside alike, every mention becomes a bracket.
    out = F.regexp_replace(out, r"(?<=\u0001|, )([0-9]+)(?=[^\u0001]*\u0002)", "Source $1")
    return F.regexp_replace(F.regexp_replace(out, r"\bSource ([0-9]+)", "[$1]"), "[\u0001\u0002]", "")


def repo_identity(remote: Column, configured: Column, dirname: Column) -> Column:
    """The key of a checkout: of its remote, else its configured name, else its folder's."""
    return F.coalesce(repo_key(remote), F.nullif(F.trim(configured), F.lit("")), dirname)
