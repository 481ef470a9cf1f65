"""Secret scans: candidates by shape, false positives removed by a random forest.

Scanning uses DataFrame functions only. Candidates are found, described and classified
inside one row's arrays, so nothing is exploded or shuffled; the fitted trees become a Column of
nested conditions over a candidate's features.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_name, materialize, named

#: Shortest candidate that its shape alone makes one, and one that a name before it announces.
LEAST, LEAST_NAMED = 16, 8
#: What a candidate is made of: a run of these characters, with dotted parts and padding.
BODY = r"[A-Za-z0-9+/_\-]{%d,}(?:\.[A-Za-z0-9_\-]{4,})*={0,2}"
#: What a name and a sign announce: the run between its quotes or delimiters, whatever it is made of.
SIGN = r"(?::=|=>|={1,3}|:)"
NAMED_VALUE = r"""(?:^|%s)[(\[{<]*(?:"([^"]{%d,})|'([^']{%d,})|`([^`]{%d,})|([^\s"'`=:][^\s"'`]{%d,}?)(?=["'`,;.)\]}>!?]*$))"""
#: The password within an address, and a private key with its header; both are told by their form.
ADDRESS = r"://[^/\s:@]*:([^@\s/]{%d,})@" % LEAST_NAMED
PEM = r"(-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z0-9 ]*PRIVATE KEY-----|$))"
MASK = "[SECRET]"

#: Words that name secrets, words that name other long codes, stand-ins.
NAMES = (
    r"(?i)(pass(word|wd|phrase)?\b|pwd|secret|token|api.?key|access.?key|auth|credential|private.?key|bearer|client.?key"
    r"|pass?wort|kennwort|geheim|schl(ü|ue)ssel|zugangs|mot.?de.?passe|\bpasse\b|\bmdp\b|jeton|cl(é|e)f?.?(api|secr|priv|d.acc)|contrase(ñ|n)a|\bclave|credencial|identifiant)"
)
OTHER_NAMES = r"(?i)(sha-?\d|md5|hash|digest|checksum|commit|uuid|guid|integrity|etag|revision|isbn|serial|version|base64|image|font|invoice|order|card|phone)"
STAND_INS = r"(?i)(example|sample|dummy|your|xxxx|placeholder|changeme|redacted|1234567|abcdef|test|todo|\*\*\*)"
#: A small dictionary whose words make identifiers and paths, not secrets.
WORDS = (
    "account action address admin agent align alpha amount angle api app array article asset async author back background badge "
    "base batch binary block blog board body book border bottom bucket build bundle button cache call card category center chain "
    "channel check child class click client clock cloud cluster code color column command comment commit common compile component "
    "config connect console content context control cookie copy core count create current custom data database date debug default "
    "delete demo deploy design detail device dialog direct document domain download draft driver east edit element email empty "
    "enable engine entry error event example export extension factory feature field file filter final first font footer form "
    "format forward frame function gallery game general get global grid group handler hash header height hidden home host html "
    "icon image import index info inner input install item java job json key label language large layer layout left length level "
    "library light limit line link list load local location login logo mail main manager map master media member menu message meta "
    "method mobile mode model module month name native network new next node normal north note number object offset online open "
    "option order output page panel parent parse part password patch path photo picture place plan player plugin point policy port "
    "position post power preview price print private process product profile program project property provider public query queue "
    "random read record region release remote remove render report request reset resource response rest result return right role "
    "root route rule sample schema screen script search section secret select server service session set settings share sheet shop "
    "short side simple site size small sort source south space stack standard start state static status step stop storage store "
    "stream string style submit summary support switch system table target task team template test text theme thread time title "
    "token tool top total track type unit update upload user util value vendor version video view web west widget width window "
    "word work world write year zone"
).split()

FEATURES = (
    "length class_changes vowel_changes digits uppers lowers distinct hex_only dictionary longest_letters slashes path_like "
    "named other_named stand_in assigned quoted known_prefix symbols equals code_like"
).split()

_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def _changes(mapped: Column) -> Column:
    """Places where neighbouring characters differ."""
    return F.length(F.regexp_replace(mapped, r"(.)\1+", "$1")) - 1


def candidates(words: Column) -> Column:
    """Array of ``value, before, after``: candidates with the words around them, in order.

    ``words`` is an array column. ``before`` is the two words before and what stands before the
    candidate in its own. A candidate is a run of LEAST characters of BODY, or, where a name and a
    sign announce it, any run of LEAST_NAMED between its quotes or delimiters (and each run
    of BODY with a digit). The password of an address counts as announced.
    """
    value_of = NAMED_VALUE % (SIGN, LEAST_NAMED, LEAST_NAMED, LEAST_NAMED, LEAST_NAMED - 1)

    def word(all_words: Column, at: Column) -> Column:
        return F.coalesce(F.get(all_words, at), F.lit(""))

    def announced(w: Column, one: Column, two: Column) -> Column:
        return (w.contains("=") | w.contains(":") | one.isin("=", ":", ":=", "=>") | one.endswith("=") | one.endswith(":")) & F.concat_ws(" ", two, one, w).rlike(NAMES)

    def is_place(i: Column) -> Column:
        w = F.get(words, i)
        long = F.length(w) >= LEAST
        return (F.length(w) >= LEAST_NAMED) & ((long & w.rlike(BODY % LEAST)) | announced(w, word(words, i - 1), word(words, i - 2)) | w.rlike(ADDRESS))

    def at(i: Column) -> Column:
        w, one, two = F.get(words, i), word(words, i - 1), word(words, i - 2)
        named_here = announced(w, one, two)
        runs = F.filter(F.regexp_extract_all(w, F.lit(f"({BODY % LEAST_NAMED})"), F.lit(1)), lambda c: (F.length(c) >= LEAST) | (named_here & c.rlike("[0-9]")))
        # In a word with its own sign the value follows the sign; a name and its sign alone are no
        # value, and addresses hold signs that announce nothing.
        signed = w.rlike(SIGN + "[^=:>]")
        own = F.when(signed, F.regexp_replace(w, "^[^=:]*(?=[=:])", "")).otherwise(w)
        whole = F.array(*(F.regexp_extract(own, value_of, g) for g in range(1, 5)))
        whole = F.filter(whole, lambda c: (c != "") & named_here & (signed | ~w.rlike("[=:>]$") | ~w.rlike(NAMES)) & ~w.contains("://"))
        inner = F.filter(F.array(F.regexp_extract(w, ADDRESS, 1)), lambda c: c != "")
        found = F.array_distinct(F.concat(whole, F.array_except(runs, inner)))
        told = F.transform(inner, lambda c: F.struct(c.alias("value"), F.concat_ws(" ", two, one, F.lit("password:")).alias("before"), word(words, i + 1).alias("after")))
        return F.concat(told, F.transform(found, lambda c: F.struct(c.alias("value"), F.concat_ws(" ", two, one, F.call_function("substring_index", w, c, F.lit(1))).alias("before"), word(words, i + 1).alias("after"))))

    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), is_place)
    return F.flatten(F.transform(places, at))


def features(c: Column) -> list[Column]:
    """A candidate's features as doubles, in the order of FEATURES."""
    v, before = c["value"], c["before"]
    n = F.length(v)
    kinds = F.translate(v, _UPPER + _LOWER + _DIGIT, "A" * 26 + "a" * 26 + "0" * 10)
    vowels = F.translate(F.lower(v), _LOWER + _DIGIT, "".join("v" if x in "aeiouy" else "c" for x in _LOWER) + "0" * 10)

    def share(pattern: str) -> Column:
        return (n - F.length(F.regexp_replace(v, pattern, ""))) / n

    left = F.regexp_replace(F.lower(v), "(?:" + "|".join(sorted(WORDS, key=lambda w: (-len(w), w))) + ")", "")
    runs = F.regexp_replace(v, "[^A-Za-z]+", " ")
    values = [
        n,
        _changes(kinds) / n,
        _changes(vowels) / n,
        share("[0-9]"),
        share("[A-Z]"),
        share("[a-z]"),
        F.size(F.array_distinct(F.split(v, ""))) / n,
        v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("double"),
        1 - F.length(left) / n,
        F.coalesce(F.array_max(F.transform(F.split(runs, " "), F.length)), F.lit(0)) / n,
        n - F.length(F.replace(v, F.lit("/"), F.lit(""))),
        (before.contains("://") | before.endswith("/") | before.endswith(".") | v.rlike("^/|/.*/|\\.[a-z]{2,4}$") | c["after"].startswith("/")).cast("double"),
        before.rlike(NAMES).cast("double"),
        F.concat_ws(" ", before, c["after"]).rlike(OTHER_NAMES).cast("double"),
        F.concat_ws(" ", before, v).rlike(STAND_INS).cast("double"),
        before.rlike("[=:]\\s*[\"'`]?$").cast("double"),
        before.rlike("[\"'`]$").cast("double"),
        v.rlike("^(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk-|sk_live_|rk_live_|AIza|eyJ|SG\\.)").cast("double"),
        share("[^A-Za-z0-9]"),
        before.rlike("=\\s*[\"'`]?$").cast("double"),
        v.rlike("[()\\[\\]{}<>$]|^[A-Za-z_]+([._][A-Za-z_]+)+$").cast("double"),
    ]
    return [x.cast("double") for x in values]


def words_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), r"\s+")


# ---------------------------------------------------------------------------- labelled findings


def labelled_findings(spark: SparkSession, rows: int = 4000) -> DataFrame:
    """``text, secret``: invented findings in context, half of them secrets. A bounded table for
    training where no reviewed findings are at hand; all values come from hashes of the row number."""

    def h(name: str, bits: int = 256) -> str:
        return f"sha2(concat('{name}', id), {bits})"

    def b64(name: str) -> str:
        return f"replace(base64(unhex({h(name)})), '=', '')"

    pick = lambda name, *xs: f"element_at(array({', '.join(repr(x) for x in xs)}), cast(pmod(xxhash64('{name}', id), {len(xs)}) + 1 as int))"
    key = pick("k", "token", "secret", "api_key", "password", "access_key", "auth_token", "client_secret", "TOKEN", "API_KEY", "Bearer", "credential", "Passwort", "Kennwort", "mot de passe", "contraseña", "clave")
    sign = pick("s", " = ", "=", ": ", ":", " := ")
    quote = pick("q", '"', "", "`")
    word = pick("w", "the", "and", "de", "la", "und", "die", "for", "release", "see", "value", "section", "item")
    other = pick("o", "commit", "sha256", "md5", "checksum", "uuid", "etag", "revision", "digest", "integrity", "order", "invoice")
    hexes = f"substr({h('a')}, 1, element_at(array(32, 40, 64), cast(pmod(xxhash64('n', id), 3) + 1 as int)))"
    letters = f"substr(translate({b64('l')}, '+/0123456789', 'rTqWzKvPxJbN'), 1, 10 + cast(pmod(id, 20) as int))"
    parts = lambda n: pick(n, "correct", "horse", "battery", "staple", "purple", "monkey", "dragon", "winter", "silver", "garden")
    phrase = f"concat_ws({pick('pj', '', '', '-')}, {parts('p2')}, {parts('p3')}, {parts('p4')})"
    mark = lambda n: pick(n, "@", "!", "#", "$", "%", "&", "*", "^")
    broken = f"concat({pick('b1', 'P', 'Wi', 'dr', 'Su', 'Qx')}, {mark('m1')}, substr({b64('r')}, 1, 2 + cast(pmod(id, 3) as int)), {mark('m2')}, {pick('b2', 'w0rd', 'nter', 'gon', 'mmer', 'kLp')}, {mark('m3')}, substr({b64('t')}, 1, 1 + cast(pmod(id, 4) as int)))"
    human = f"concat({pick('hu', 'hunter', 'dragon', 'monkey', 'sommer', 'soleil', 'amigos', 'tigre', 'Winter', 'shadow')}, cast(10 + pmod(xxhash64('hn', id), 9990) as string), {pick('hs', '', 'x', '!', 'qz')})"
    prose = pick("pr", "required", "something", "forgotten", "important", "available", "international", "notwendig", "Verfahren", "différent", "necesario", "security", "management", "Authentication", "expired,", "invalid.")
    code = pick("co", "request.headers", "getPassword(user)", "process.env.API_KEY", "os.environ[TOKEN]", "config.get(name)", "settings.secret_key", "this.props.token", "undefined", "${API_TOKEN}", "<password>", "***********")
    true = [
        f"concat({key}, {sign}, {quote}, {hexes}, {quote})",
        f"concat({key}, {sign}, {quote}, upper({hexes}), {quote})",
        f"concat({key}, {sign}, {quote}, substr({b64('b')}, 1, 20 + cast(pmod(id, 20) as int)), {quote})",
        f"concat({word}, {quote}, ' AKIA', substr(upper(translate({b64('c')}, '+/', 'XY')), 1, 16), {quote})",
        f"concat({key}, {sign}, {quote}, 'ghp_', substr(translate({b64('d')}, '+/', 'ab'), 1, 36), {quote})",
        f"concat({key}, {sign}, 'eyJhbGciOiJIUzI1NiJ9.eyJz', substr(translate({b64('e')}, '+/', '-_'), 1, 30), '.', translate({b64('f')}, '+/', '-_'))",
        f"concat({key}, {sign}, {quote}, 'sk_live_', substr(translate({b64('g')}, '+/', 'cd'), 1, 24), {quote})",
        f"concat({key}, {sign}, {quote}, substr(translate({b64('p')}, '+/', '7k'), 1, 10 + cast(pmod(id, 6) as int)), {quote})",
        # Without a digit, or broken up by punctuation.
        f"concat({word}, {quote}, ' AKIA', substr(upper(translate({b64('c')}, '+/0189', 'XYABCD')), 1, 16), {quote})",
        f"concat({key}, {sign}, {quote}, {letters}, {quote})",
        f"concat({key}, {sign}, {quote}, {phrase}, {quote})",
        f"concat({key}, {sign}, {quote}, {broken}, {quote})",
        f"concat({pick('sc', 'postgres', 'mysql', 'https', 'redis', 'amqp')}, '://', {pick('us', 'admin', 'root', 'app', 'deploy')}, ':', CASE WHEN pmod(xxhash64('uh', id), 2) = 0 THEN concat({human}, 'ab') ELSE substr({b64('pu')}, 1, 8 + cast(pmod(id, 9) as int)) END, '@db.example.net/', {word})",
        f"concat({key}, {sign}, {quote}, {human}, {quote})",
    ]
    ident = f"concat_ws({pick('j', '_', '-', '')}, {pick('i1', 'user', 'image', 'content', 'project', 'The')}, {pick('i2', 'Settings', 'Header', 'Version', 'Template', 'thereing')}, {pick('i3', 'Manager', 'Controller', 'Index', 'Storage', 'Gallery')}, cast(pmod(id, 97) as string))"
    uuid = f"concat_ws('-', substr({h('u')}, 1, 8), substr({h('u')}, 9, 4), substr({h('u')}, 13, 4), substr({h('u')}, 17, 4), substr({h('u')}, 21, 12))"
    false = [
        f"concat({other}, {pick('s2', ' ', ': ', ' = ')}, {hexes}, ' ', {word})",
        f"concat({word}, ' ', {uuid}, ' ', {word})",
        f"concat({word}, ' ', {ident}, ' ', {word})",
        f"concat({key}, {sign}, {quote}, {pick('h', 'your_api_key_here_123', 'example-token-12345678', 'xxxxxxxxxxxxxxxx0000', 'changeme_password_01', 'dummySecretValue1234', 'test_token_1234567890')}, {quote})",
        f"concat({word}, ' ', lpad(cast(pmod(xxhash64('cc', id), 9999999999999999) as string), 16, '4'), ' ', {word})",
        f"concat('https://www.example.com/', {pick('p1', 'static', 'images', 'blog', 'news')}, '/', {ident}, '/', substr({h('z')}, 1, 20), {pick('x', '.png', '.js', '.html', '')})",
        f"concat('data:image/png;base64,', {b64('y')}, {b64('x')})",
        f"concat({key}, {sign}, {quote}, {ident}, {quote})",
        f"concat('/usr/local/lib/python3.11/site-packages/', {ident}, '/', {word}, '_v', cast(pmod(id, 9) as string))",
        f"concat({key}, {pick('s3', ': ', ': ', ':', ' = ')}, {prose}, ' ', {word})",
        f"concat({key}, {sign}, {code})",
        f"concat({word}, ' ', {pick('lw', 'Verantwortungsbewusstsein', 'internationalization', 'characteristically', 'responsabilidades', 'anticonstitutionnellement', 'state-of-the-art-systems', 'AWS_SECRET_ACCESS_KEY', 'RESPONSABILIDADES', 'INTERNATIONALIZATION', 'VERANTWORTUNGSBEWUSSTSEIN', 'CONSTITUTIONNELLE', 'getElementsByClassName')}, ' ', {word})",
        f"concat({word}, ' mail', cast(pmod(id, 999) as string), '@mail', cast(pmod(id, 9) as string), '.example.com ', {word}, ' ', cast(pmod(xxhash64('d', id), 20000000) as string), '-05-12T10:22:33')",
    ]

    def case(options: list[str]) -> str:
        whens = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(options))
        return f"CASE pmod(xxhash64('case', id), {len(options)}) {whens} END"

    made = spark.range(0, rows, 1, 1).selectExpr("id % 2 = 0 AS secret", f"concat({word}, ' ', CASE WHEN id % 2 = 0 THEN {case(true)} ELSE {case(false)} END, ' ', {word}) AS text")
    return made.select("text", F.col("secret").cast("int").alias("secret"))


# ------------------------------------------------------------------------------------ the forest


@dataclass(frozen=True)
class Forest:
    """Trees as nested (feature, threshold, left, right) tuples; leaves are shares of secrets."""

    trees: tuple

    def score(self, f: Column) -> Column:
        def of(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(node)
            at, threshold, left, right = node
            return F.when(f[FEATURES[at]] <= threshold, of(left)).otherwise(of(right))

        total = of(self.trees[0])
        for t in self.trees[1:]:
            total = total + of(t)
        return total / float(len(self.trees))


def train(labelled: DataFrame, trees: int = 12, depth: int = 6, seed: int = 17, most_rows: int = 20_000) -> Forest:
    """Fit a forest to ``text, secret`` rows (at most ``most_rows``, the bound of the sample).

    A text's candidates all carry its label; texts without a candidate teach nothing.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = labelled.limit(most_rows).withColumn("words", words_of(F.col("text")))
    rows = rows.select("secret", F.explode(candidates(F.col("words"))).alias("c"))
    table = rows.select(F.col("secret").cast("double").alias("label"), *(x.alias(n) for n, x in zip(FEATURES, features(F.col("c")), strict=True)))
    table = materialize(table, "labelled")
    table = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(table).select("label", "features").coalesce(1)
    fitted = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=64, featureSubsetStrategy="onethird").fit(table)

    def node_of(node):
        if node.getClass().getSimpleName() == "LeafNode":
            stats = list(node.impurityStats().stats())
            return float(stats[1] / sum(stats)) if sum(stats) else 0.0
        split = node.split()
        return split.featureIndex(), float(split.threshold()), node_of(node.leftChild()), node_of(node.rightChild())

    return Forest(tuple(node_of(t._call_java("rootNode")) for t in fitted.trees))


def scan(df: DataFrame, forest: Forest, text_col: str = "text", least_score: float = 0.5, findings_col: str = "findings") -> DataFrame:
    """``df`` with the array ``findings_col`` of ``value, score, secret``, one per candidate.

    Whole texts are looked at. A private key with its header is one finding by its form alone, with
    score 1; all others are judged by the forest. Null and empty texts have no finding and get an empty array.
    Repeated rows stay, an empty table gives an empty one. A map: no join, no shuffle.
    """
    words, found, described = (fresh_name(df, n) for n in ("_w", "_found", "_described"))
    step = df.withColumn(words, words_of(named(text_col)))
    step = step.withColumn(found, candidates(named(words)))
    step = step.withColumn(described, F.transform(named(found), lambda c: F.struct(c["value"].alias("value"), *(x.alias(n) for n, x in zip(FEATURES, features(c), strict=True)))))
    scored = F.transform(named(described), lambda f: F.struct(f["value"].alias("value"), forest.score(f).alias("score")))
    judged = F.transform(scored, lambda s: F.struct(s["value"].alias("value"), s["score"].alias("score"), (s["score"] >= least_score).alias("secret")))
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    keys = F.when(text.contains("PRIVATE KEY-----"), F.regexp_extract_all(text, F.lit(PEM), F.lit(1))).otherwise(F.array().cast("array<string>"))
    judged = F.concat(F.transform(keys, lambda k: F.struct(k.alias("value"), F.lit(1.0).alias("score"), F.lit(True).alias("secret"))), judged)
    # A generator of one row: conditions on the findings are then not pushed below, where the
    # optimizer would repeat the whole forest for each of them.
    return step.withColumn(findings_col, F.explode_outer(F.array(judged))).drop(words, found, described)


def redact(df: DataFrame, text_col: str = "text", findings_col: str = "findings") -> DataFrame:
    """``df`` with each secret of ``findings_col`` masked in its text wherever it stands, longest first.

    A null text stays null, a text without a secret as it is; repeated rows stay, an empty table
    gives an empty one. Each different secret costs a search of its text.
    """
    secrets = F.array_distinct(F.transform(F.filter(named(findings_col), lambda x: x["secret"]), lambda x: x["value"]))
    ordered = F.transform(F.array_sort(F.transform(secrets, lambda s: F.struct((-F.length(s)).alias("n"), s.alias("s")))), lambda x: x["s"])
    masked = F.aggregate(ordered, named(text_col).cast("string"), lambda t, s: F.replace(t, s, F.lit(MASK)))
    return df.withColumn(text_col, F.when(F.size(secrets) > 0, masked).otherwise(named(text_col).cast("string")))
