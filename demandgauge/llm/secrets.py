"""Secret scan (native): candidates by pattern, false positives removed by a random forest.

Candidates are long runs of key characters with a digit, also after ``=``, and values of eight characters or more after any
name and ``:`` or ``=``.  A value in quotes after a name such as ``token`` or ``password`` reaches to the closing quote; others
reach to white space or a quote, whatever symbols they hold, but not over the next ``&name=``, ``;name=`` or
``,name:``, a closing tag, or commas and semicolons at the end.  A forest, trained on labelled findings, judges each by its length,
changes of character class, spread of characters, share of dictionary words, known prefixes, the path (here: the source name) and the
neighbouring words.  The trees become one SQL expression, so candidates are judged inside their row:
no join, no shuffle, no Python.

``labelled_findings`` makes the training table by rule: ``TRAINING`` rows of keys, tokens and passwords in their usual
surroundings, against check sums, commit ids, identifiers, numbers, paths and placeholders.  Any table with the same
columns can be used instead; at most ``TRAINING`` rows of it by hash order are used, which bounds the fit.

Defined results: null and empty texts have no findings; a null path counts as empty; equal rows
give equal findings; spans are code points, end exclusive; an empty table gives none.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRAINING = 1200
SURE = 0.5
_KEY = r"(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{16,}+"
# Padding belongs to a run, the sign of an assignment does not.
_RUN = rf"(?<![A-Za-z0-9+/_\-]){_KEY}(?:={{1,2}}(?![A-Za-z0-9+/_\-]|[\"'][A-Za-z0-9]))?"
# The short look-behind comes first: it turns most places down before the names are tried.
_AFTER = r"(?<=[:=\"']|[:=] )"
_SECRET_NAME = r"(?i:pass|pwd|secret|token|api[_\-]?key|access[_\-]?key|private[_\-]?key|credential)[A-Za-z0-9_\-]{0,20}"
_NAMED = rf"(?<={_SECRET_NAME}[\"']? ?[:=] ?[\"']?)"
_END = r"[\s\"']|\z|&(?:amp;)?[A-Za-z0-9_.\-]{1,40}=|[,;]{1,4}(?:\s|\z|[A-Za-z0-9_.\- ]{1,40}[:=])|</[A-Za-z]"
# A run that only closing marks follow is taken as a run, without them.
_NOT_RUN = rf"(?!{_KEY}={{0,2}}[)\]}}>.,;:]*(?:[\s\"']|\z))"


def _unquoted(end: str) -> str:
    """Eight or more characters up to the first ``end``; a lazy loop over one character class needs no stack."""
    return rf"(?![^\s\"']{{0,7}}(?:{end})){_NOT_RUN}[^\s\"']{{8,}}?(?={end})"


def _quoted(quote: str) -> str:
    """All up to the closing quote of the line, which is not escaped."""
    return rf"(?<={quote})(?![^\r\n]{{0,7}}(?<!\\){quote})[^\r\n]{{8,}}?(?<!\\)(?={quote})"


_ASSIGNED = rf"{_AFTER}{_NAMED}(?:{_quoted(chr(34))}|{_quoted(chr(39))}|{_unquoted(_END)})"
# Under any other name: no URL, and no text that assigns to a secret's name itself, whose value is a candidate of its own.
_OTHER = (
    rf"{_AFTER}(?<=[A-Za-z0-9_\])][\"']? ?[:=] ?[\"']?)(?!//|[A-Za-z][A-Za-z0-9+.\-]{{0,20}}://|[^\s\"']{{0,400}}?{_SECRET_NAME}[:=])"
    + _unquoted(rf"{_END}|\?[A-Za-z0-9_.\-]{{1,40}}=|[)\]}}>.,;]{{1,4}}(?:[\s\"']|\z)"))
CANDIDATE = f"{_ASSIGNED}|{_OTHER}|{_RUN}"
_DICTIONARY = (
    "password|example|version|license|public|private|server|client|config|default|test|user|name|file|path|data|index|value|table|query|class|"
    "function|string|number|object|image|release|build|package|module|http|https|www|html|json|your|this|that|with|from|the|and|for|changeme|dummy|sample")
FEATURES = ["size", "changes", "spread", "digits", "upper", "hexadecimal", "words", "named", "denied", "assigned", "test_path", "issuer", "symbols"]


def features(value: Column, before: Column, after: Column, path: Column) -> list[Column]:
    """The numbers the forest judges by, in the order of ``FEATURES``; ``before``, ``after``: up to 40 characters around."""
    size = F.length(value)
    low = F.lower(value)
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]+", "a"), "[A-Z]+", "b"), "[0-9]+", "c"), "[^abc]+", "d")
    letters = F.split(value, "")
    left = lambda pattern: F.length(F.regexp_replace(value, pattern, ""))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return [
        size.cast("double"), F.length(kinds) / size, F.size(F.array_distinct(letters)) / size, 1 - left("[0-9]") / size, 1 - left("[A-Z]") / size,
        flag(low.rlike("^[0-9a-f]+$")), 1 - F.length(F.regexp_replace(low, _DICTIONARY, "")) / size,
        flag(F.lower(before).rlike(r"(token|secret|secret.?key|pass|passwd|password|passphrase|passcode|pwd|api.?key|access.?key(.?id)?|auth|bearer|credentials?|private.?key|[^a-z](pat|sig|signature))[^a-z]{0,12}$")),
        flag(F.lower(before).rlike(r"(sha[0-9-]*|md5|commit|hash|checksum|digest|integrity|uuid|guid|revision|etag|version|isbn|phone|order|(?<!key.)id|example|\+)[^a-z]{0,12}$")),
        flag(before.rlike("[:=] ?[\"']?$") | after.rlike("^[\"']")),
        flag(F.lower(path).rlike("test|example|sample|doc|fixture|mock")),
        flag(value.rlike("^(AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|AIza|xox[abprs]-|sk_live_)")), F.length(F.regexp_replace(value, r"[A-Za-z0-9+/_=.\s-]+", "")) / size,
    ]


def labelled_findings(spark: SparkSession, n: int = TRAINING) -> DataFrame:
    """(value, before, after, path, secret): findings made by rule, half of them secrets."""
    return spark.range(n).selectExpr(
        "id", "sha2(concat('a', id), 256) AS h", "base64(unhex(sha2(concat('b', id), 256))) AS b", "CAST(id % 2 = 0 AS int) AS secret",
        "CAST(floor(id / 2) % 12 AS int) AS kind", "CAST(floor(id / 24) % 8 AS int) AS place",
        "element_at(array('index', 'table', 'client', 'server', 'release', 'module', 'config', 'user', 'image', 'public'), CAST(1 + id % 10 AS int)) AS w1",
        "element_at(array('name', 'version', 'value', 'build', 'path', 'query', 'class', 'data', 'default'), CAST(1 + id % 9 AS int)) AS w2",
    ).selectExpr(
        "id", "secret",
        """CASE WHEN secret = 1 THEN element_at(array(substr(h, 1, 40), substr(h, 1, 32), substr(b, 1, 40), concat('AKIA', upper(substr(h, 1, 16))),
               concat('ghp_', substr(replace(replace(b, '/', 'x'), '+', 'Y'), 1, 36)), upper(substr(h, 1, 40)), substr(b, 1, 24), concat(substr(b, 3, 9), '!', substr(h, 1, 2)),
               concat('AIza', substr(replace(replace(b, '/', '_'), '+', '-'), 1, 35)), concat(upper(substr(h, 1, 1)), '@$$', substr(b, 2, 3), substr(h, 5, 4)),
               concat(initcap(w1), '&', substr(h, 1, 1), substr(b, 6, 3), element_at(array('#', '%', '*', '!', '$', '<', '>', '^'), place + 1), id % 100), concat(substr(b, 1, 5), '#', substr(b, 7, 4), '*', substr(h, 1, 3))), kind + 1)
           ELSE element_at(array(substr(h, 1, 40), h, concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-4', substr(h, 13, 3), '-a', substr(h, 16, 3), '-', substr(h, 19, 12)),
               concat(w1, '_', w2, '_', id % 1000, '_', w1), concat('/', w1, '/', w2, '/', w1, '-', id % 100, '/', w2), lpad(CAST(pmod(xxhash64(id), 10000000000000000) AS string), 16, '4'),
               element_at(array('your_token_here_123', 'changeme123', 'xxxxxxxxxxxxxxxx0000', 'example-password-1', 'dummy_secret_value_1', '<your-password>', '<your_token_1>', 'password1234'), place + 1),
               concat('https//www/', w1, w2, id % 50), concat(w1, w2), concat(w1, '.', w2, '(', w1, ')'), concat(10 + id % 14, ':', 10 + id % 50, ':', 10 + id % 49), concat('$', '{', upper(w1), '_', upper(w2), '}')), kind + 1) END AS value""",
        """CASE WHEN secret = 1 THEN element_at(array('and token = "', 'api_key: ', 'the secret="', 'password = ', 'Authorization: Bearer ', 'DB_PASSWORD=', IF(kind IN (3, 4, 8), 'MY_KEY=', 'AWS_SECRET_ACCESS_KEY='), IF(kind IN (3, 4, 8), 'at ?key=', '&token=')), place + 1)
           ELSE element_at(array(element_at(array('commit ', 'fixed in commit ', 'revision: ', 'hash = "', 'see ', 'GIT_COMMIT=', 'hash=', '?revision='), place + 1),
               element_at(array('sha256: ', 'checksum = "', 'digest: ', 'integrity sha256-', 'etag "', 'SHA256=', '?digest=', 'md5='), place + 1),
               element_at(array('uuid = "', 'id: ', 'guid ', 'order id ', 'uuid: ', 'ORDER_ID=', '?id=', '&uuid='), place + 1),
               element_at(array('the ', 'import ', 'call ', 'of = "', 'see ', 'MODULE=', '?name=', 'name: '), place + 1),
               element_at(array('in ', 'from ', 'path = "', 'open ', 'at ', 'HOME=', '?path=', 'file: '), place + 1),
               element_at(array('card ', 'de ', 'phone +', 'number: ', 'order ', 'ORDER=', '?order=', 'phone: '), place + 1),
               element_at(array('token = "', 'password: ', 'secret="', 'password = "', 'api_key = ', 'DB_PASSWORD=', 'API_TOKEN=', '&token='), place + 1),
               element_at(array('at ', 'see ', 'from ', 'url = "', 'link: ', 'BASE_URL=', '?next=', 'href="'), place + 1),
               element_at(array('note: ', 'he said: ', 'kind=', 'title = "', 'the name: ', 'MODE=', '?sort=', 'key: '), place + 1),
               element_at(array('token = ', 'password = ', 'x = ', 'secret: ', 'call: ', 'y=', 'user = ', 'token='), place + 1),
               element_at(array('time: ', 'at=', 'date = "', 'start: ', 'T=', 'END=', '?t=', 'until: '), place + 1),
               element_at(array('token = "', 'password: ', 'secret="', 'password = "', 'api_key = ', 'DB_PASSWORD=', 'API_TOKEN=', 'PAT='), place + 1)), kind + 1) END AS before""",
        "element_at(array('\"', ' and', '\"', '', '.', '', ' ', '&x=1'), place + 1) AS after",
        "element_at(array('src/app', 'tests/unit', 'src0', 'docs/example', 'src7'), CAST(1 + floor(id / 3) % 5 AS int)) AS path")


class Forest:
    """A fitted forest; its trees become one SQL expression."""

    def __init__(self, findings: DataFrame, trees: int = 25, depth: int = 6):
        rows = findings.select("secret", *(c.alias(n) for n, c in zip(FEATURES, features(*map(F.col, ("value", "before", "after", "path"))), strict=True)))
        rows = rows.orderBy(F.xxhash64(*FEATURES)).limit(TRAINING)
        data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows.withColumn("label", F.col("secret").cast("double")))
        model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, maxBins=64).fit(data.repartition(1))
        self.trees = [self._node(t._java_obj.rootNode()) for t in model.trees]

    def _node(self, node):
        if node.getClass().getSimpleName() == "LeafNode":
            no, yes = node.impurityStats().stats()[0], node.impurityStats().stats()[1]
            return yes / (no + yes)
        return node.split().featureIndex(), node.split().threshold(), self._node(node.leftChild()), self._node(node.rightChild())

    def score(self, numbers: Column) -> Column:
        """Mean vote of the trees for an array of features."""
        def vote(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            at, threshold, left, right = node
            return F.when(numbers[at] <= threshold, vote(left)).otherwise(vote(right))
        total = F.lit(0.0)
        for t in self.trees:
            total = total + vote(t)
        return total / len(self.trees)


def find(docs: DataFrame, forest: Forest, text: str = "text", path: str | None = "source") -> DataFrame:
    """``docs`` with ``findings``: array of (start, end, value, score), all candidates in order of place."""
    where = F.coalesce(F.col(path), F.lit("")) if path else F.lit("")
    pieces = (
        docs.withColumn("_path", where)
        .withColumn("_values", F.when(F.col(text).rlike(CANDIDATE), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))))
        .withColumn("_gaps", F.when(F.col("_values").isNotNull(), F.split(text, CANDIDATE)))
    )
    # The gaps and values alternate, so running sums of their lengths give the places.
    steps = F.expr("""
        aggregate(sequence(1, size(_values)), CAST(array() AS array<struct<start:int,end:int,i:int>>), (a, i) -> concat(a, array(named_struct(
            'start', IF(i = 1, 0, element_at(a, -1).end) + length(_gaps[i - 1]),
            'end', IF(i = 1, 0, element_at(a, -1).end) + length(_gaps[i - 1]) + length(_values[i - 1]), 'i', i - 1))))""")
    placed = pieces.withColumn("_places", F.when(F.size("_values") > 0, steps))
    described = F.transform("_places", lambda p: F.struct(
        p["start"].alias("start"), p["end"].alias("end"), F.get("_values", p["i"]).alias("value"),
        F.array(*features(F.get("_values", p["i"]), F.right(F.concat(F.when(p["i"] > 0, F.get("_values", p["i"] - 1)).otherwise(""), F.get("_gaps", p["i"])), F.lit(40)), F.left(F.get("_gaps", p["i"] + 1), F.lit(40)), F.col("_path"))).alias("f")))
    judged = placed.withColumn("_described", described).withColumn("findings", F.transform("_described", lambda d: F.struct(
        d["start"].alias("start"), d["end"].alias("end"), d["value"].alias("value"), F.round(forest.score(d["f"]), 6).alias("score"))))
    none = F.array().cast("array<struct<start:int,end:int,value:string,score:double>>")
    return judged.withColumn("findings", F.coalesce("findings", none)).drop("_path", "_values", "_gaps", "_places", "_described")


def redact(docs: DataFrame, forest: Forest, text: str = "text", path: str | None = "source", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; all other columns and rows stay."""
    found = find(docs, forest, text, path).withColumn("findings", F.filter("findings", lambda f: f["score"] >= SURE))
    # Between secrets the text stays; each part starts where the last secret ended.
    redacted = F.expr(f"""
        concat(array_join(transform(findings, (f, i) -> substring({text}, IF(i = 0, 0, findings[i - 1].end) + 1, f.start - IF(i = 0, 0, findings[i - 1].end))), '{mark}'),
               '{mark}', substring({text}, element_at(findings, -1).end + 1))""")
    return found.withColumn(text, F.when(F.size("findings") > 0, redacted).otherwise(F.col(text))).select(*docs.columns)
