"""Secret scan: candidates by pattern, false positives removed by a random forest, in SQL functions only.

A candidate is what is assigned to a name that may hold a credential, a long run of key characters, or a block
of a private key. The forest sees its length, character classes and the transitions between them, the share of it
that dictionary words cover, signs of a path, and the neighbouring words. It is trained on a table of labelled
findings; where none is given, on findings that a seeded rule makes and labels. It is scored as one expression
over the features.
"""

from __future__ import annotations

import string
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, row_key
from .forest import as_sql, grow

THRESHOLD = 0.5
#: A private key's block; the name and sign of an assignment with its value, a quoted one up to the next such quote of
#: its line; or a bare run.
FINDING = r"""(?:-----BEGIN (?:[A-Z0-9]{1,12} ){0,3}PRIVATE KEY-----[A-Za-z0-9+/=:,\-\s]*?-----END (?:[A-Z0-9]{1,12} ){0,3}PRIVATE KEY-----)|(?:[A-Za-z0-9_\-.]{2,30}["']?[ \t]{0,2}[=:][ \t]{0,2}(?:"[^"\n]{8,}+"|'[^'\n]{8,}+'|["']?[A-Za-z0-9+/_\-.=~!@#$%^&*?]{8,}+))|(?:(?<![A-Za-z0-9+/_\-.=])[A-Za-z0-9+/_\-.]{20,}+={0,2})"""
PARTS = r"""^(?:(?:([A-Za-z0-9_\-.]{2,30})["']?[ \t]{0,2}[=:][ \t]{0,2})?(?:"([^"\n]{8,}+)"|'([^'\n]{8,}+)'|["']?([^"'\n]{8,}+))|(-----BEGIN[\s\S]+))$"""
#: Words of names that hold credentials, of places that don't, of stand-ins, and of a dictionary.
NAME_WORDS = "token|secret|passw|passwd|pwd|api_?key|apikey|access_?key|private|credential|auth|bearer"
OTHER_WORDS = "sha|md5|hash|commit|digest|checksum|rev|uuid|guid|version|build|path|file|url|href|src|class|title|name|date|time|id|page|host"
STAND_INS = "example|sample|dummy|placeholder|changeme|change_me|your|xxxx|test|fake|todo|insert|redacted|none|null|true|false|1234|abcd|0000"
DICTIONARY = (
    "the|and|ing|tion|for|with|that|this|from|are|was|has|not|you|all|her|his|one|our|out|day|get|him|how|man|new|now|old|see|two|way|who|"
    "user|name|value|config|setting|service|server|client|data|base|table|index|item|list|map|key|node|test|case|main|file|path|home|local|"
    "public|static|class|function|return|import|module|package|version|release|build|default|option|param|query|result|error|message|event|"
    "handler|manager|factory|controller|model|view|page|image|style|script|link|text|word|line|time|date|year|http|https|www|html|json|xml|"
    "load|save|read|write|open|close|start|stop|send|receive|create|update|delete|insert|select|where|order|group|count|total|average"
)
FEATURES = [
    "length", "digits", "uppers", "lowers", "others", "runs", "letters_kinds", "covered", "slashes", "dots", "is_hex", "is_number",
    "named", "good_name", "other_name", "stand_in", "has_equals", "good_before", "other_before", "good_after", "other_after",
]
#: Characters on each side of a finding, up to the next finding, of which the nearest WORDS_NEAR words are neighbours.
NEAR, WORDS_NEAR = 60, 3
#: Findings made for training.
TRAIN_FINDINGS = 4000


def with_features(df: DataFrame, name: str = "key_name", value: str = "candidate", before: str | None = None, after: str | None = None) -> DataFrame:
    """Adds the columns FEATURES, from the candidate, the name before it and the neighbouring words, if given."""
    near = {side: F.lower(F.coalesce(F.col(c), F.lit(""))) if c else F.lit("") for side, c in (("before", before), ("after", after))}
    v, low = F.col(value), F.lower(F.col(value))
    size = F.greatest(F.length(v), F.lit(1)).cast("double")
    kinds = F.translate(v, string.ascii_lowercase + string.ascii_uppercase + string.digits, "a" * 26 + "A" * 26 + "0" * 10)
    key = F.lower(F.coalesce(F.col(name), F.lit("")))
    number = lambda c: c.cast("double")
    gone = lambda c, chars: number(F.length(c)) - F.length(F.translate(c, chars, ""))
    flags = lambda c, words: number(F.rlike(c, F.lit(words)).cast("int"))
    made = {
        "length": number(F.length(v)),
        "digits": gone(v, string.digits) / size,
        "uppers": gone(v, string.ascii_uppercase) / size,
        "lowers": gone(v, string.ascii_lowercase) / size,
        "runs": number(F.length(F.regexp_replace(kinds, r"(.)\1+", "$1"))) / size,
        "letters_kinds": number(F.size(F.array_distinct(F.split(low, "")))) / size,
        "covered": 1 - number(F.length(F.regexp_replace(low, f"({DICTIONARY})", ""))) / size,
        "slashes": gone(v, "/"),
        "dots": gone(v, "."),
        "is_hex": flags(low, "^[0-9a-f-]+$"),
        "is_number": flags(v, r"^[0-9.,:_\-]+$"),
        "named": flags(key, "."),
        "good_name": flags(key, NAME_WORDS),
        "other_name": flags(key, f"(^|_|-|\\.)({OTHER_WORDS})($|_|-|\\.|[0-9])"),
        "stand_in": flags(low, STAND_INS),
        "has_equals": flags(v, "=$"),
    }
    for side, text in near.items():
        made[f"good_{side}"] = flags(text, f"(^| )({NAME_WORDS.replace('_?', '[ _]?')})")
        made[f"other_{side}"] = flags(text, f"(^| )({OTHER_WORDS})[0-9]*($| )")
    out = df.withColumns(made)
    return out.withColumn("others", 1 - F.col("digits") - F.col("uppers") - F.col("lowers"))


def made_long_and_quoted(count: int = 800, seed: int = 13) -> list[tuple[str, str, int]]:
    """Labelled findings as of made_findings, of long tokens and of quoted values with punctuation."""
    rng = np.random.default_rng(seed)
    pick = lambda options: options[int(rng.integers(len(options)))]
    run = lambda chars, n: "".join(chars[i] for i in rng.integers(0, len(chars), n))
    words = lambda sep, n: sep.join(pick(DICTIONARY.split("|")) for _ in range(n))
    mixed = string.ascii_letters + string.digits
    good = ["token", "secret", "api_key", "password", "passwd", "auth_token", "client_secret", "db_password"]
    bad = ["title", "class", "content", "name", "said", "href", "style", "path", "alt", ""]
    out = []
    for _ in range(count // 4):
        size = int(np.exp(rng.uniform(np.log(80), np.log(3000))))
        out.append((pick([*good, ""]), run(mixed + pick(["", "+/", "-_."]), size), 1))
        out.append((pick(good), run(mixed + "&!@#$%^*?", int(rng.integers(8, 25))), 1))
        out.append((pick([*bad, "of", "said"]), words("", int(rng.integers(2, 5))) + run("%*&$#!?", 1) * int(rng.integers(1, 4)), 0))
        kind = pick(["", "RSA ", "EC ", "OPENSSH ", "DSA ", "ENCRYPTED "])
        block = f"-----BEGIN {kind}PRIVATE KEY-----\n" + "\n".join(run(mixed + "+/", 64) for _ in range(int(rng.integers(1, 27)))) + f"\n-----END {kind}PRIVATE KEY-----"
        out.append(("", block, 1))
        out.append((pick(bad), words(" ", int(rng.integers(3, 40))) + pick(["", ".", "!"]), 0))
        out.append((pick(bad), pick([words("/", int(rng.integers(12, 200))), words("-", int(rng.integers(12, 200))), run(string.digits, size)]), 0))
    return out


def made_findings(count: int = TRAIN_FINDINGS, seed: int = 11) -> list[tuple[str, str, int]]:
    """Labelled findings (name before it or '', candidate, 1 for a secret) from a seeded rule."""
    rng = np.random.default_rng(seed)
    pick = lambda options: options[int(rng.integers(len(options)))]
    run = lambda chars, n: "".join(chars[i] for i in rng.integers(0, len(chars), n))
    word = lambda: pick(DICTIONARY.split("|"))
    syllables = lambda: "".join(run("bcdfghklmnprstvw", 1) + run("aeiou", 1) + run("nrstl", int(rng.integers(0, 2))) for _ in range(int(rng.integers(4, 9))))
    mixed = string.ascii_letters + string.digits
    good = ["token", "secret", "api_key", "apikey", "password", "passwd", "access_key", "auth_token", "client_secret", "private_key", "db_password", "AWS_SECRET_ACCESS_KEY"]
    bad = ["sha", "md5", "commit", "hash", "checksum", "file", "path", "url", "version", "id", "class", "title", "name", "page", "uuid", "href", "date"]
    out = []
    for _ in range(count // 2):
        kind = int(rng.integers(6))
        value = [
            lambda: run("0123456789abcdef", int(pick([32, 40, 40, 40, 64]))),
            lambda: run(mixed, int(rng.integers(20, 65))),
            lambda: pick(["ghp_", "sk_live_", "AKIA", "xoxb-", "glpat-"]) + run(mixed, int(rng.integers(16, 41))),
            lambda: run(mixed + "+/", int(rng.integers(22, 87))) + pick(["", "=", "=="]),
            lambda: run(mixed + "_-.~", int(rng.integers(10, 25))),
            lambda: run("0123456789abcdef", 40),
        ][kind]()
        out.append((pick(good) if kind in (0, 4, 5) or rng.random() < 0.7 else "", value, 1))
        kind = int(rng.integers(9))
        value = [
            lambda: run("0123456789abcdef", int(pick([32, 40, 64]))),
            lambda: "-".join(run("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)),
            lambda: "/".join(word() for _ in range(int(rng.integers(3, 7)))) + pick(["", ".html", ".py", ".png"]),
            lambda: pick(["_", "-", "."]).join(word() for _ in range(int(rng.integers(3, 6)))),
            lambda: pick(["your", "example", "test", "dummy", "changeme", "xxxx"]) + pick(["_", "-", ""]) + pick(["token", "key", "secret", "password"]) + pick(["_here", "1234", "-value", ""]),
            lambda: syllables(),
            lambda: run(string.digits, int(rng.integers(8, 24))),
            lambda: run("-=._", 1) * int(rng.integers(20, 60)),
            lambda: word() + "." + word() + "@" * 0 + "." + pick(["com", "org", "net"]) + "/" + word() + "/" + run(string.digits, 5),
        ][kind]()
        name = pick(good) if kind == 4 or kind in (3, 5) and rng.random() < 0.5 else pick(bad) if kind < 2 or rng.random() < 0.4 else ""
        out.append((name, value, 0))
    return out


def made_in_context(count: int = 2000, seed: int = 17) -> list[tuple[str, str, int, str, str]]:
    """Labelled findings with the words before and after them; those of bare runs tell secrets from digests."""
    rng = np.random.default_rng(seed)
    pick = lambda options: options[int(rng.integers(len(options)))]
    run = lambda chars, n: "".join(chars[i] for i in rng.integers(0, len(chars), n))
    plain = lambda: " ".join(pick(["the", "and", "in", "of", "was", "this", "we", "then", "see", "it"]) for _ in range(int(rng.integers(0, 4))))
    good = ["authorization bearer", "bearer", "token", "password is", "api key", "secret key", "auth token", "the secret", "credential", "private key"]
    other = ["commit", "sha256", "md5", "checksum", "at revision hash", "the commit", "digest sha1", "version", "build", "uuid"]
    out = []
    for i in range(count):
        secret = i % 2
        value = run("0123456789abcdef", int(pick([32, 40, 40, 64])))
        words = pick(good if secret else other)
        sides = (words, plain()) if rng.random() < 0.75 else (plain(), pick(["is the ", "as ", ""]) + words)
        out.append(("", value, secret, *sides))
    # the rest of the findings stand in words that say nothing
    return out + [(*row, plain(), plain()) for row in made_findings() + made_long_and_quoted()]


@lru_cache(maxsize=4)
def _forest(session: int, findings: tuple) -> list:
    spark = SparkSession.getActiveSession()
    rows = [(*row, "", "")[:5] for row in findings]
    made = spark.createDataFrame(rows, "key_name string, candidate string, label int, before string, after string")
    rows = with_features(made, before="before", after="after").select("label", *FEATURES).collect()
    rows = np.array(sorted(tuple(r) for r in rows), float)
    return grow(rows[:, 1:], rows[:, 0])


#: Most labelled findings of a table that a forest is trained on: those of the smallest hashes.
TRAIN_ROWS = 20_000
LABELLED = ["key_name", "candidate", "label", "before", "after"]


def train(spark: SparkSession, labelled: DataFrame | None = None) -> list:
    """Forest trained on labelled findings, by default on made_in_context().

    labelled: (key_name, candidate, label 0 or 1, before, after); null names and neighbours count as empty, rows
    without candidate or label are left out.
    """
    if labelled is None:
        return _forest(id(spark), tuple(made_in_context()))
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) if c not in ("candidate", "label") else F.col(c) for c in LABELLED]
    rows = labelled.select(*text).dropna().orderBy(F.xxhash64(*LABELLED), *LABELLED).limit(TRAIN_ROWS).collect()
    return _forest(id(spark), tuple(map(tuple, rows)))


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k_id, k_hash, number, key_name, candidate, before, after) of each document, by number of occurrence.

    before and after hold the nearest words, as far as the neighbouring findings.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(*row_key(id_col, text_col), text.alias("text"), F.regexp_extract_all(text, F.lit(FINDING), F.lit(0)).alias("all")).filter("size(all) > 0")
    # piece i ends where finding i begins, piece i + 1 begins where it ends
    rows = base.select("k_id", "k_hash", F.posexplode(F.arrays_zip("all", *_around(F.split("text", FINDING)))).alias("number", "found")).filter("found.all is not null")
    part = lambda i: F.regexp_extract("found.all", PARTS, i)
    return rows.select("k_id", "k_hash", "number", part(1).alias("key_name"), F.concat(part(2), part(3), part(4), part(5)).alias("candidate"), "found.before", "found.after")


def _around(pieces: Column) -> tuple[Column, Column]:
    words = lambda c: F.filter(F.split(c, "[^A-Za-z0-9]+"), lambda w: w != "")
    join = lambda c: F.array_join(F.slice(c, 1, WORDS_NEAR), " ")
    before = F.transform(pieces, lambda p: F.array_join(F.reverse(F.slice(F.reverse(words(F.right(p, F.lit(NEAR)))), 1, WORDS_NEAR)), " "))
    after = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: join(words(F.left(p, F.lit(NEAR)))))
    return before.alias("before"), after.alias("after")


def findings(docs: DataFrame, forest: list, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(k_id, k_hash, number, key_name, candidate, score, secret) of every candidate."""
    scored = with_features(candidates(docs, id_col, text_col), before="before", after="after").withColumn("score", F.expr(as_sql(forest, FEATURES)))
    return scored.select("k_id", "k_hash", "number", "key_name", "candidate", "score", (F.col("score") >= threshold).alias("secret"))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, labelled: DataFrame | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_candidates, n_secrets, secrets (distinct, sorted); labelled: as for train().

    Null and empty texts have no candidates; repeated rows each get a row; an empty table gives an empty result.
    Other columns are not read. A document's findings meet in one row, so its own length bounds them.
    """
    key = ["k_id", "k_hash"]
    spark = docs.sparkSession
    # of repeated rows, each finding counts once: places are told apart by number
    found = findings(docs, train(spark, labelled), id_col, text_col, threshold).groupBy(*key, "number").agg(F.max("candidate").alias("candidate"), F.max("secret").alias("secret"))
    found = found.groupBy(*key).agg(
        F.count("*").alias("n_candidates"), F.count_if("secret").alias("n_secrets"),
        F.array_sort(F.collect_set(F.when(F.col("secret"), F.col("candidate")))).alias("secrets"),
    )
    out = docs.select(F.col(id_col).alias("doc_id"), *row_key(id_col, text_col)).join(materialize(found, "secrets"), key, "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", F.coalesce("n_candidates", zero).alias("n_candidates"), F.coalesce("n_secrets", zero).alias("n_secrets"), F.coalesce("secrets", F.array().cast("array<string>")).alias("secrets"))
