"""Secret scans with a random forest that removes false positives.

Candidates are found line by line: values of six or more characters assigned to a secret-like name, issued key
ids, runs of ten or more token characters with a digit, and private keys from their header to their end line (or, if
there is none, to the last base64 line).  Each candidate is described by its length, its transitions between
character classes, the part of it that dictionary words cover, whether it looks like a path (and whether the row's own
path is of tests or examples), and the words around it (the 40 characters before it, white space squeezed).  A random
forest, trained from labelled findings, votes on it; its trees are nested conditions over these columns,
so scoring stays within the row and needs no shuffle.

The forest is trained by Spark's own trainer from `labelled_findings`, a fixed number of labelled
candidates made by rule, or from any table of the same columns.

Defined cases: null text has no candidates and stays null; an empty text stays empty; spans are (line,
column, length) in code points, counted from 0, a private key having the line breaks within it in its length;
a null path is no path; repeated rows are scanned alike; an empty table gives an empty result; other columns are
kept, and `scan_secrets` refuses a table that has its result column already.  A text with the control character
U+0001 has its private keys masked line by line only.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, free_name

NAMES = "password|passwd|pwd|passphrase|(?<![A-Za-z])pass|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|client[_-]?secret|credential"
SIGN = "[\"']?\\s*+[:=]{1,2}+>?+\\s*+[\"']?"
#: A name that a value is assigned to is no token itself.
GENERIC = f"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{{10,}}+(?!(?<=(?i:{NAMES}))[\"']?\\s*+[:=](?!=))={{0,2}}"
ASSIGNED = f"(?i:{NAMES}){SIGN}(?=[^\\s\"',;<>]{{6}})[^\\s\"',;<>]++"
HEADER = "-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"
_BODY = "A-Za-z0-9+/=:,.\\s\\x01\\\\"
#: A private key; within a line, its line breaks are written U+0001.
BLOCK = f"{HEADER}(?:[{_BODY}]*+(?:-[{_BODY}]++)*+-----END [A-Z0-9 ]*PRIVATE KEY-----|(?:[A-Za-z0-9+/=\\r\\n\\x01]*[A-Za-z0-9+/=](?![^\\r\\n\\x01]))?)"
#: Issued keys, by their beginnings; they may have no digit.
ISSUED = "(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|(?:gh[pousr]_|glpat-|xox[abprs]-|[sr]k_live_|sk_test_)[A-Za-z0-9_-]{16,}+)(?![A-Za-z0-9])"
CANDIDATE = f"{BLOCK}|{ASSIGNED}|{ISSUED}|{GENERIC}"
#: A line without this has no candidate.
HINT = f"{GENERIC}|{ISSUED}|(?i:{NAMES})[\"']?\\s*+[:=]|{HEADER}"
MASK = "[SECRET]"

# Common words of code and prose.
DICTIONARY = """about account address admin after again all also and any api app array assert auth base block body book build button cache call card case change chapter char check child class clear client clone close code color column command commit common component config content context control copy count create current custom data database date day debug default delete demo depend device dir disk display document domain down drive driver dummy edit element email enable end error event example export factory false field file filter final find first float folder font for form format frame from front function game get github given global graph group handle hash header height hello help home host html http image import index info init input insert install instance int integer internal invoice item java job json key label language last layout length level lib library license like line link list load local lock log login long loop main make manager map mark master max memory menu message method min mode model module month move name native net network new next node note null number object offset open option order other out output owner package page param parent parse part pass patch path pattern phone placeholder plain play plugin point port post prefix print private process product profile project property public query queue random range read record ref release remote remove report request require reset resource response result return root route row rule run sample save scale schema screen script search section select send serial server service session set setting shape short show side simple single size some sort source space spec src stack stage standard start state static status step stop storage store stream string style sub success suffix switch symbol sync system table tag target task temp template test text that the theme this thread time title tmp token tool top total trace track tree true type unit unknown update upload url user utf util value var vector version video view web week where while widget width window with word work world write year your zone""".split()
KNOWN = "^(AKIA|ASIA|gh[pousr]_|xox[abprs]-|AIza|sk_(live|test)_|rk_live_|eyJ[A-Za-z0-9]|glpat-|-----BEGIN)"
BENIGN = "(?i)(sha-?[0-9]*|md5|commit|checksum|digest|hash|uuid|guid|isbn|issn|doi|order|invoice|phone|tel|fax|card|version|build|example|sample|dummy|placeholder|page|chapter|section|serial|id|no|figure)[\\s:.=#\"'(-]{0,4}$"
FEATURES = ["length", "transitions", "runs", "digits", "upper", "distinct", "dictionary", "hex", "uuid", "known", "slashes", "dots", "test_path", "named", "near_secret", "near_benign", "quoted", "after_word", "password"]


def _share(value: Column, pattern: str) -> Column:
    n = F.greatest(F.length(value), F.lit(1))
    return (F.length(value) - F.length(F.regexp_replace(value, pattern, ""))).cast("double") / n


def features(value: Column, before: Column, after: Column, path: Column) -> list[Column]:
    """The features of a candidate, in the order of FEATURES.  `before` and `after` are the neighbouring text."""
    kinds = value
    for pattern, kind in (("[a-z]", "a"), ("[A-Z]", "B"), ("[0-9]", "1"), ("[^aB1]", "-")):
        kinds = F.regexp_replace(kinds, pattern, kind)
    runs = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")).cast("double")
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    near = F.right(F.regexp_replace(before, r"\s+", " "), F.lit(40))
    return [
        n,
        (runs - 1) / F.greatest(n - 1, F.lit(1.0)),
        runs,
        _share(value, "[0-9]"),
        _share(value, "[A-Z]"),
        F.size(F.array_distinct(F.split(value, ""))).cast("double") / n,
        _share(F.lower(value), "|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=len, reverse=True))),
        yes(value.rlike("^(0x)?([0-9a-f]+|[0-9A-F]+)$")),
        yes(value.rlike("^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")),
        yes(value.rlike(KNOWN)),
        _share(value, "/"),
        _share(value, "[._-]"),
        yes(F.lower(F.coalesce(path, F.lit(""))).rlike("test|example|sample|fixture|mock|doc")),
        yes(near.rlike(f"(?i)({NAMES}){SIGN}$")),
        yes(near.rlike(f"(?i)({NAMES}|bearer|authorization|private)")),
        yes(near.rlike(BENIGN)),
        yes(near.rlike("[\"'`]$")),
        yes(after.rlike("^\\s+[A-Za-z]")),
        yes(near.rlike(f"(?i)(pass(word|wd|phrase)?|pwd){SIGN}$")),
    ]


class Forest:
    """Trees as nested tuples (feature, threshold, left, right), with a share of secrets in each leaf."""

    def __init__(self, trees: list):
        self.trees = trees

    def column(self, x: Column) -> Column:
        """The mean vote of the trees; `x` is a struct with the fields FEATURES."""

        def tree(t) -> Column:
            if not isinstance(t, tuple):
                return F.lit(float(t))
            return F.when(x[FEATURES[t[0]]] <= t[1], tree(t[2])).otherwise(tree(t[3]))

        return reduce(lambda a, b: a + b, map(tree, self.trees)) / float(len(self.trees))

    def score(self, row: list[float]) -> float:
        """The same for one list of features."""

        def tree(t) -> float:
            while isinstance(t, tuple):
                t = t[2] if row[t[0]] <= t[1] else t[3]
            return float(t)

        return sum(map(tree, self.trees)) / len(self.trees)


def _letters(alphabet: str, n: Column, salt: int) -> Column:
    """A random string of n letters, by row."""
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(F.lit(alphabet), F.pmod(F.xxhash64(F.col("id"), i, F.lit(salt)), F.lit(len(alphabet))).cast("int") + 1, F.lit(1))), "")


def _one_of(words: list[str], salt: int) -> Column:
    return F.get(F.array(*map(F.lit, words)), F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(len(words))).cast("int"))


def labelled_findings(spark: SparkSession, each: int = 150) -> DataFrame:
    """Findings (value, before, after, path, label) of 16 kinds of secrets and 19 kinds of false positives.

    Each kind occurs under plain paths and under those of tests, examples and fixtures; there, six kinds of
    secrets are false positives."""
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexa, any62 = num + "abcdef", low + up + num
    between = lambda a, b, salt: (F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(b - a + 1)) + a).cast("int")
    named = F.concat(_one_of(["password", "token", "secret", "api_key", "Password", "access_key", "client_secret", "passwd"], 1), _one_of(["=", ": ", " = ", '="', ' = "', ": '"], 2))
    plain = F.concat(_one_of(["", "the ", "of ", "see ", "in the ", "with ", "and ", "new "], 3))
    word = lambda salt: _one_of(DICTIONARY, salt)
    fixed = lambda n: F.lit(n)
    uuid = F.concat_ws("-", *[_letters(hexa, fixed(n), 30 + i) for i, n in enumerate((8, 4, 4, 4, 12))])
    opened = F.concat(_one_of(["password", "Password", "passwd", "pwd", "DB_PASS", "pass", "passphrase"], 84), _one_of(["=", ": ", " = ", '="', ' = "', ": '"], 85))
    lines = F.array_join(F.transform(F.sequence(F.lit(1), between(1, 20, 86)), lambda i: _letters(any62 + "+/", fixed(64), 87)), "\n")
    upper_words = F.upper(F.concat(word(51), word(52), word(53)))
    secret = [
        (F.concat(F.lit("AKIA"), _letters(up + "234567", fixed(16), 4)), plain), (F.concat(F.lit("AKIA"), _letters(up + num, fixed(16), 5)), named),
        (_letters(hexa, fixed(40), 6), named), (_letters(hexa, between(14, 64, 7), 8), named), (_letters(any62, between(10, 48, 9), 10), named),
        (_letters(any62 + "+/", between(24, 64, 11), 12), named), (F.concat(F.lit("ghp_"), _letters(any62, fixed(36), 13)), plain), (F.concat(F.lit("sk_live_"), _letters(any62, fixed(24), 14)), plain),
        (F.concat(F.lit("eyJ"), _letters(any62, between(20, 60, 15), 16)), plain), (F.concat(F.lit("AIza"), _letters(any62 + "_-", fixed(35), 17)), plain),
        (F.concat(F.lit("xoxb-"), _letters(num, fixed(12), 18), F.lit("-"), _letters(any62, fixed(24), 19)), plain), (F.concat(F.lit("-----BEGIN "), _one_of(["", "RSA ", "EC "], 20), F.lit("PRIVATE KEY-----")), F.lit("")),
        (F.concat(F.lit("-----BEGIN PRIVATE KEY-----\n"), lines, F.lit("\n-----END PRIVATE KEY-----")), F.lit("")),
        (F.concat(_letters(low, between(4, 8, 88), 89), _letters(num, between(1, 4, 90), 91), _letters(low, between(0, 8, 92), 93)), opened),
        (F.concat(word(94), word(95), word(96), _letters(low, between(2, 6, 97), 98)), opened), (_letters(low, between(10, 20, 99), 100), opened),
    ]
    wrong = [
        (_letters(hexa, fixed(40), 21), _one_of(["commit ", "sha1 ", "sha: ", "checksum ", "digest: ", "hash "], 22)), (_letters(hexa, fixed(32), 23), _one_of(["md5 ", "md5: ", "hash: ", "checksum ", "id "], 24)),
        (_letters(hexa, fixed(64), 25), _one_of(["sha256 ", "sha256:", "digest ", "hash "], 26)), (uuid, _one_of(["id ", "uuid ", "guid: ", "the ", "request "], 27)),
        (_letters(num, between(10, 19, 28), 29), _one_of(["card ", "phone ", "order ", "no ", "", "the ", "and "], 41)), (F.concat(_letters(num, fixed(4), 42), F.lit("-"), _letters(num, fixed(4), 43), F.lit("-"), _letters(num, fixed(4), 44)), plain),
        (F.concat(F.lit("20"), _letters("0123", fixed(2), 45), F.lit("-0"), _letters("1234", fixed(1), 46), F.lit("-1"), _letters(num, fixed(1), 47), F.lit("T1"), _letters(num, fixed(1), 48)), plain),
        (F.concat(word(54), F.lit("/"), word(55), F.lit("/"), word(56), _letters(num, fixed(1), 57)), plain), (F.concat(word(58), F.lit("_"), word(59), F.lit("_"), word(60), _letters(num, between(1, 3, 61), 62)), plain),
        (F.concat(word(63), word(64), word(65), _letters(num, between(1, 4, 66), 67)), plain), (upper_words, named), (_one_of(["changeme", "your-token", "<secret>", "placeholder", "example", "xxxxxxxx", "********", "password123", "none-given", "process.env"], 68), named),
        (F.concat(F.lit("${"), F.upper(word(69)), F.lit("_"), F.upper(word(70)), F.lit("}")), named), (F.concat(word(71), F.lit("."), word(72), F.lit("()")), named),
        (F.concat(_letters(low, between(6, 14, 73), 74), _letters(num, between(1, 2, 75), 76), _letters(low, between(2, 8, 77), 78)), plain), (_letters(num, between(6, 12, 79), 80), named),
        (_one_of(["required", "optional", "string", "String", "incorrect", "invalid", "expired", "missing", "needed", "changed", "protected", "forgotten", "hidden", "disabled", "enabled", "manager", "policy", "boolean", "varchar"], 101), opened),
        (F.concat(_one_of(["os.environ[", "self.", "args.", "user.", "config.", "settings.", "request.form[", "process.env.", "$", "getpass.", "input("], 102), _one_of(["password", "passwd", "pass_word", "getpass()", "secret_value"], 103)), opened),
        (F.concat(_one_of(["get", "read", "load", "make", "hash", "check"], 104), F.initcap(word(105)), F.lit("(")), opened),
    ]
    after, path = _one_of(["", " the", '"', "'", ",", " of", "\n", ". And"], 81), _one_of(["src/main.py", "app/config.yml", "notes.txt", "", "web", "data"], 82)
    tried = _one_of(["tests/test_login.py", "examples/app.py", "fixtures/users.json", "src/test/Main.java", "mocks/api.js"], 83)
    # Assigned strings of no issued kind: in tests and examples they are made up.
    made_up = [*secret[3:6], *secret[13:]]
    kinds = [(1.0, path, secret), (0.0, path, wrong), (1.0, tried, [*secret[:3], *secret[6:13]]), (0.0, tried, [*wrong, *made_up])]
    rows = [F.struct(v.alias("value"), b.alias("before"), after.alias("after"), p.alias("path"), F.lit(label).alias("label")) for label, p, own in kinds for v, b in own]
    # Within a lambda these many expressions are evaluated as they are, not compiled into one method.
    made = spark.range(0, each, 1, 1).select(F.explode(F.flatten(F.transform(F.array("id"), lambda _: F.array(*rows)))).alias("r"))
    return made.select("r.*")


def train(findings: DataFrame, trees: int = 20, depth: int = 7, seed: int = 11) -> Forest:
    """A forest from labelled findings (value, before, after, path, label), in one partition so that the
    draws of the trees are the same each time."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    told = bind(F.struct("value", "before", "after", "path"), lambda p: F.struct(*[c.alias(n) for c, n in zip(features(p["value"], p["before"], p["after"], p["path"]), FEATURES)]))
    rows = findings.select(told.alias("x"), "label").select("x.*", "label").coalesce(1)
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("features", "label")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(vectors)
    return Forest([read_tree(t.toDebugString) for t in model.trees])


def read_tree(text: str):
    """The nested form of a tree that Spark has written out."""
    lines = [x.strip() for x in text.splitlines()[1:] if x.strip()]

    def node():
        line = lines.pop(0)
        if line.startswith("Predict"):
            return float(line.split()[-1])
        feature, threshold = re.match(r"If \(feature (\d+) <= ([-0-9.eE]+)\)", line).groups()
        left = node()
        lines.pop(0)  # Else
        return (int(feature), float(threshold), left, node())

    return node()


def _sums_before(steps: Column, block: int = 512) -> Column:
    """For each number of an array, the sum of those before it; in two levels, so that no long array is copied for each."""
    own = lambda x, first: F.aggregate(x, F.struct(first.alias("at"), F.array().cast("array<int>").alias("own")), lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["own"], F.array(a["at"])).alias("own")))["own"]
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / block).cast("int")), lambda b: F.slice(steps, b * block + 1, F.lit(block)))
    whole = lambda x: F.aggregate(x, F.lit(0), lambda a, n: a + n)
    return bind(blocks, lambda bs: F.flatten(F.zip_with(bs, own(F.transform(bs, whole), F.lit(0)), own)))


def scan_lines(text: Column, path: Column, forest: Forest, threshold: float = 0.5) -> Column:
    """A struct of `findings` (line, column, value, score, secret) and the `masked` text."""
    finding = "array<struct<line:int,column:int,value:string,score:double,secret:boolean>>"
    def one(line: Column, at_line: Column, keyed: Column) -> Column:
        broken = lambda x: F.when(keyed, F.replace(x, F.lit("\x01"), F.lit("\n"))).otherwise(x)
        found, parts = F.regexp_extract_all(line, F.lit(CANDIDATE), F.lit(0)), F.split(line, CANDIDATE, -1)
        pairs = F.arrays_zip(found.alias("found"), F.slice(parts, 1, F.size(found)).alias("before"), F.slice(parts, 2, F.size(found)).alias("after"))
        # What an assigned value is assigned to belongs to the text before it.
        lead = lambda p: F.regexp_extract(p["found"], f"^(?i:{NAMES}){SIGN}", 0)
        cutup = F.transform(pairs, lambda p: F.struct(F.substr(p["found"], F.length(lead(p)) + 1).alias("value"), F.concat(p["before"], lead(p)).alias("before"), p["after"].alias("after")))
        told = F.transform(cutup, lambda p: F.struct(p["value"].alias("value"), p["before"].alias("before"), F.struct(*[c.alias(n) for c, n in zip(features(p["value"], p["before"], p["after"], path), FEATURES)]).alias("x")))
        scored = F.transform(told, lambda p: F.struct(p["value"].alias("value"), p["before"].alias("before"), forest.column(p["x"]).alias("score")))

        def placed(s: Column) -> Column:
            starts = _sums_before(F.transform(s, lambda p: F.length(p["before"]) + F.length(p["value"])))

            def found_at(p: Column, start: Column) -> Column:
                head = F.left(line, start + F.length(p["before"]))
                within = keyed & F.contains(line, F.lit("\x01"))  # a private key is in the line
                lines = at_line + F.when(within, F.length(head) - F.length(F.replace(head, F.lit("\x01"), F.lit("")))).otherwise(0)
                column = F.when(within, F.length(F.substring_index(head, "\x01", -1))).otherwise(start + F.length(p["before"]))
                return F.struct(lines.cast("int").alias("line"), column.cast("int").alias("column"), broken(p["value"]).alias("value"), p["score"].alias("score"), (p["score"] >= threshold).alias("secret"))

            own = F.zip_with(s, starts, found_at)
            masked = F.transform(s, lambda p: F.concat(p["before"], F.when(p["score"] >= threshold, F.lit(MASK)).otherwise(broken(p["value"]))))
            return F.struct(own.cast(finding).alias("own"), F.concat(F.array_join(masked, ""), F.element_at(parts, -1)).alias("line"))

        plain = F.struct(F.array().cast(finding).alias("own"), line.alias("line"))
        return F.when(line.rlike(CANDIDATE), bind(scored, placed)).otherwise(plain)

    def whole(w: Column) -> Column:
        def number(i: Column) -> Column:  # lines that private keys before this one have beside their first
            return i + F.aggregate(F.filter(w["breaks"], lambda b: b["at"] < i), F.lit(0), lambda a, b: a + b["n"])

        lines = F.transform(w["lines"], lambda x, i: F.when(x.rlike(HINT), one(x, number(i), F.size(w["breaks"]) > 0)).otherwise(F.struct(F.array().cast(finding).alias("own"), x.alias("line"))))
        return bind(lines, lambda x: F.struct(F.flatten(F.transform(x, lambda y: y["own"])).alias("findings"), F.array_join(F.transform(x, lambda y: y["line"]), "\n").alias("masked")))

    keyed = text.rlike(HEADER) & ~F.contains(text, F.lit("\x01"))
    blocks, around = F.transform(F.regexp_extract_all(text, F.lit(BLOCK), F.lit(0)), lambda b: F.replace(b, F.lit("\n"), F.lit("\x01"))), F.split(text, BLOCK, -1)
    joined = F.when(keyed, F.array_join(F.zip_with(around, blocks, lambda p, b: F.concat(p, F.coalesce(b, F.lit("")))), "")).otherwise(text)
    counted = lambda lines: F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), (F.length(x) - F.length(F.replace(x, F.lit("\x01"), F.lit("")))).alias("n"))), lambda b: b["n"] > 0)
    breaks = lambda lines: F.when(keyed, counted(lines)).otherwise(F.array().cast("array<struct<at:int,n:int>>"))
    done = bind(bind(F.split(joined, "\n"), lambda lines: F.struct(lines.alias("lines"), breaks(lines).alias("breaks"))), whole)
    none = F.struct(F.array().cast(finding).alias("findings"), text.alias("masked"))
    return F.when(text.rlike(HINT), done).otherwise(none)


def scan_secrets(documents: DataFrame, text: str = "text", path: str = "source", forest: Forest | None = None, result: str = "scan") -> DataFrame:
    """The documents with a struct column `result`: findings and masked text.  A table without the column `path`
    is scanned without paths."""
    if result.lower() in map(str.lower, documents.columns):
        raise ValueError(f"the table has a column {result} already")
    forest = forest or train(labelled_findings(documents.sparkSession))
    own = F.col(path) if path in documents.columns else F.lit(None).cast("string")
    return documents.withColumn(result, scan_lines(F.col(text), own, forest))


def mask_secrets(documents: DataFrame, text: str = "text", path: str = "source", chars: str = "n_chars") -> DataFrame:
    """The documents with every secret masked, and their lengths as they are then, if they have a column of those."""
    name = free_name(documents, "__scan")
    scanned = scan_secrets(documents, text, path, result=name).withColumn(text, F.col(f"{name}.masked"))
    if chars in documents.columns:
        scanned = scanned.withColumn(chars, F.length(text).cast("long"))
    return scanned.select(*documents.columns)
