"""Secret scan with corpus-wide ownership frequency.

Candidates are found by one pattern over whole texts, kept as hashes, and
counted over the corpus: in how many repositories and by how many owners does
the same value appear? A value that several owners carry, or that is made up as
a placeholder, is an example that was copied; a varied value of one or two
owners looks live. All of it is Catalyst expressions and one grouped aggregate,
so it runs without Python.

``documents`` has no repository or owner column, so by default the owner is
``source`` and its repositories are that source's languages (``source/lang``);
both are parameters. A null owner or repository counts as one unknown one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import cut, read

#: Anything may stand before a name: AWS_SECRET_ACCESS_KEY ends in one.
_NAMES = r"(?i:api[_-]?key|access[_-]?key|client[_-]?secret|secret[_-]?key|secret|auth[_-]?token|token|passwd|password|pwd)"
_SIGN = r"[\"']? ?[=:] ?"
#: A value without quotes: 12 characters or more with a digit, so that code (token = get_token(...)) and prose are none; a full stop after it isn't part of it.
_BARE = r"(?![=/])(?=[A-Za-z0-9_/+=.~-]{12})(?=[A-Za-z_/+=.~-]*+[0-9])[A-Za-z0-9_/+=~-]++(?:\.++[A-Za-z0-9_/+=~-]++)*+(?=\.*+(?:[\s,;&\"'`<)\]}\\]|$))"
#: A line of an .env file needs no digit: nothing but NAME=value.
_ENV_LEAD = r"^[ \t]*+(?:export[ \t]++)?[A-Za-z0-9_.-]*?" + _NAMES + "="
_ENV = r"(?m:" + _ENV_LEAD + r"(?!=)[A-Za-z0-9_/+=.~-]{12,}+(?=[ \t\r]*+$))"
#: A private key up to its END line, or as far as it goes without one: header lines, then base64 with line ends of any kind, also written as \n in a string.
_KEY_BLOCK = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:\s|\\[rn])*+"
    r"(?:[A-Za-z][A-Za-z0-9-]*+: [^\r\n\\]*+(?:\s|\\[rn])++)*+[A-Za-z0-9+/=\s\\]{32,}+"
)
#: Alternatives: key = value assignments, and values known by their shape, each as long as it is. Possessive
#: repetition, which neither steps back nor recurses, keeps a long value cheap; it is Java's syntax, not RE2's.
PATTERN = (
    _ENV + "|" + _NAMES + _SIGN + r"(?:[\"'][A-Za-z0-9_/+=.~-]{12,}+[\"']|" + _BARE + ")"
    r"|\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36,}\b|\bxox[abprs]-[A-Za-z0-9-]{10,}\b|\bsk-[A-Za-z0-9_-]{20,}\b"
    r"|\bAIza[0-9A-Za-z_-]{35}\b|\beyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
    r"|" + _KEY_BLOCK + r"|\b[a-z][a-z0-9+]{2,12}://[A-Za-z0-9_.-]++:[A-Za-z0-9_.~!%-]{6,}+@"
)
#: The value within a match: what follows the sign of an assignment, without quotes.
LEAD = "^" + _NAMES + _SIGN + r"[\"']?|" + _ENV_LEAD + r"|[\"']$"
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|your|xxxx|0000|1234567|abcdef0|test"
#: In a value of more than LONG_CHARS, such as a key block, four or five letters turn up by chance.
LONG_CHARS, LONG_PLACEHOLDER = 512, r"(?i)example|sample|placeholder|changeme|xxxxxxxx|00000000|1234567|abcdef0"
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES, MIN_DISTINCT_CHARS = 3, 5, 8


def _values(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    return F.transform(found, lambda m: F.regexp_replace(m, LEAD, ""))


def _looks_live(value: Column) -> Column:
    made_up = F.when(F.length(value) > LONG_CHARS, value.rlike(LONG_PLACEHOLDER)).otherwise(value.rlike(PLACEHOLDER))
    return (F.size(F.array_distinct(F.split(value, ""))) >= MIN_DISTINCT_CHARS) & ~made_up


def _kind(value: Column) -> Column:
    out = F.when(value.startswith("AKIA"), "aws_key").when(value.rlike("^gh[pousr]_"), "github_token").when(value.startswith("xox"), "slack_token")
    out = out.when(value.startswith("sk-"), "api_secret").when(value.startswith("AIza"), "google_key").when(value.startswith("eyJ"), "jwt")
    return out.when(value.startswith("-----"), "private_key").when(value.contains("://"), "url_password").otherwise("assigned")


def _candidates(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        F.coalesce(repository.cast("string"), F.lit("")).alias("repository"),
        F.explode(_values(F.col("text").cast("string"))).alias("value"),
    )
    return own.groupBy("doc_id", "owner", "repository", "value").agg(F.count("*").alias("occurrences"))


def _judged(docs: DataFrame, owner: Column | None, repository: Column | None) -> DataFrame:
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))) if repository is None else repository
    found = cut(_candidates(docs, owner, repository))
    spread = found.groupBy("value").agg(F.countDistinct("repository").alias("n_repositories"), F.countDistinct("owner").alias("n_owners"))
    verdict = (
        F.when((F.col("n_owners") >= EXAMPLE_OWNERS) | (F.col("n_repositories") >= EXAMPLE_REPOSITORIES), "example")
        .when(~_looks_live(F.col("value")), "placeholder")
        .otherwise("live")
    )
    return found.join(spread, "value").withColumn("verdict", verdict)


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that the documents don't have."""
    while name in docs.columns:
        name += "_"
    return name


def secret_scan(docs: DataFrame, owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """One row per document and candidate value: doc_id, kind, secret_hash, occurrences, n_repositories, n_owners, verdict.

    verdict is "example" (copied by 3 owners or 5 repositories or more),
    "placeholder" (too few different characters, or a made-up word in it) or
    "live". Values appear only as SHA-256. Rows that repeat a doc_id, owner and
    repository add up their occurrences; null doc_ids of one repository count as
    one document. Null or empty texts have no candidate; texts of any length are searched whole.
    Extra columns are ignored; an empty table gives no row.
    """
    return _judged(docs, owner, repository).select("doc_id", _kind(F.col("value")).alias("kind"), F.sha2("value", 256).alias("secret_hash"), "occurrences", "n_repositories", "n_owners", "verdict")


def redact_secrets(docs: DataFrame, owner: Column | None = None, repository: Column | None = None, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every live-looking value replaced, n_chars brought up to date; other columns as they were, whatever their names.

    Every row of ``docs`` stays, repeated ones too; null, empty and clean texts stay as they are, and texts
    of any length are searched whole. A row without a doc_id can't be joined with the
    corpus counts: there every varied value that is no placeholder is replaced.
    """
    live = _judged(docs, owner, repository).where("verdict = 'live' and doc_id is not null")
    names = [_fresh(docs, c) for c in ("live_doc", "live_values", "new_text")]
    live = live.groupBy(F.col("doc_id").alias(names[0])).agg(F.collect_set("value").alias(names[1]))
    joined = docs.join(live, docs["doc_id"].cast("long") == live[names[0]], "left")
    # Longer values first, so that a value within another leaves nothing of it.
    order = lambda a: F.array_sort(a, lambda x, y: F.when(F.length(x) != F.length(y), F.length(y) - F.length(x)).when(x < y, -1).when(x > y, 1).otherwise(0))
    local = F.filter(_values(F.col("text").cast("string")), _looks_live)
    values = F.when(F.col("doc_id").isNull(), local).otherwise(F.coalesce(F.col(names[1]), F.array().cast("array<string>")))
    text = F.when(F.size(values) > 0, F.aggregate(order(values), F.col("text"), lambda t, v: F.replace(t, v, F.lit(mark)))).otherwise(F.col("text"))
    out = joined.withColumn(names[2], text)
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col(names[2]).alias("text"))
        elif c == "n_chars":
            changed = F.col("text").isNotNull() & (F.col(names[2]) != F.col("text"))
            columns.append(F.when(changed, F.length(names[2]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars"))
        else:
            columns.append(F.col(f"`{c}`"))
    return out.select(*columns)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(read(spark, sf_dir, "documents"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: The SQL stays as registered: narrower than PATTERN (values of limited length and in quotes, names without a prefix), with the same rows on the given tables.
_SQL_PATTERN = (
    r"(?i:\b(?:api[_-]?key|access[_-]?key|client[_-]?secret|secret[_-]?key|secret|auth[_-]?token|token|passwd|password|pwd))"
    r"[\"']? ?[=:] ?[\"'][A-Za-z0-9_/+=.~-]{12,512}[\"']"
    r"|\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36,255}\b|\bxox[abprs]-[A-Za-z0-9-]{10,200}\b|\bsk-[A-Za-z0-9_-]{20,200}\b"
    r"|\bAIza[0-9A-Za-z_-]{35}\b|\beyJ[A-Za-z0-9_-]{8,1000}\.[A-Za-z0-9_-]{8,1000}\.[A-Za-z0-9_-]{8,1000}"
    r"|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/= \n]{32,1000}"
    r"|\b[a-z][a-z0-9+]{2,12}://[A-Za-z0-9_.-]{1,64}:[A-Za-z0-9_.~!%-]{6,128}@"
)
_SQL_LEAD = r"^[A-Za-z_-]+[\"']? ?[=:] ?[\"']|[\"']$"
_VALUE = f"unnest(list_transform(regexp_extract_all(text, {_quoted(_SQL_PATTERN)}, 0), lambda m: regexp_replace(m, {_quoted(_SQL_LEAD)}, '', 'g')))"
QUERIES = {"op10_secret_scan": op10_secret_scan}
SQL = {
    "op10_secret_scan": f"""
WITH found AS (
    SELECT doc_id, coalesce(source, '') AS owner, coalesce(source, '') || '/' || coalesce(lang, '') AS repository, {_VALUE} AS value
    FROM documents
), counted AS (
    SELECT doc_id, owner, repository, value, count(*) AS occurrences FROM found GROUP BY ALL
), spread AS (
    SELECT value, count(DISTINCT repository) AS n_repositories, count(DISTINCT owner) AS n_owners FROM counted GROUP BY value
)
SELECT doc_id,
       CASE WHEN starts_with(value, 'AKIA') THEN 'aws_key' WHEN regexp_matches(value, '^gh[pousr]_') THEN 'github_token'
            WHEN starts_with(value, 'xox') THEN 'slack_token' WHEN starts_with(value, 'sk-') THEN 'api_secret'
            WHEN starts_with(value, 'AIza') THEN 'google_key' WHEN starts_with(value, 'eyJ') THEN 'jwt'
            WHEN starts_with(value, '-----') THEN 'private_key' WHEN contains(value, '://') THEN 'url_password' ELSE 'assigned' END AS kind,
       sha256(value) AS secret_hash, occurrences, n_repositories, n_owners,
       CASE WHEN n_owners >= {EXAMPLE_OWNERS} OR n_repositories >= {EXAMPLE_REPOSITORIES} THEN 'example'
            WHEN len(list_distinct(string_split(value, ''))) < {MIN_DISTINCT_CHARS} OR regexp_matches(value, {_quoted(PLACEHOLDER)}) THEN 'placeholder'
            ELSE 'live' END AS verdict
FROM counted JOIN spread USING (value)
"""
}
