"""Personal data: pattern matches as seeds, and what contexts learnt from them find besides."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import texts_of

KINDS = ("email", "ip", "card", "phone")
#: Kinds beyond the base ones, with seeds of their own: bank account numbers by their check digits, and values of high
#: entropy behind a name and a sign.
MORE = ("iban", "secret")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_SET = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_MARKED = re.compile(r"[0-9@]")
_EDGE = "\"'()[]{}<>,;:.!?*%$&#=|"
_TOKEN = re.compile(r"\w+|[^\w\s]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\Z")
_VALUE, _NAMED = re.compile(r"[A-Za-z0-9+/_=-]{20,}\Z"), re.compile(r"[\w\])][ \t]*[=:][ \t]*[\"'`]?\Z")
#: Bits a character from which a value is no word; tokens of a pattern on one side at most, characters of one token.
ENTROPY, REACH, TOKEN = 3.0, 3, 64

#: A pattern needs so many known instances and such a share of them against those that contradict it; what an unknown
#: instance of the kind's shape weighs against it.
LEAST_KNOWN, CONFIDENCE, UNKNOWN = 3, 0.8, 0.1
#: Shapes of identifiers by kind; unknown instances of another shape contradict a pattern.
SHAPES = {"email": "[^ ]*@[^ ]*", "ip": "[0-9a-f]*([.:][0-9a-f]*){2,}(/[0-9]+)?", "card": "([a-z]{2})?([ ./-]?[0-9]){12,32}",
          "phone": "[+(]{0,2}[0-9]([ ()./-]{0,3}[0-9]){6,14}",
          "iban": "[a-z]{2}[0-9]{2}( ?[a-z0-9]){11,30}", "secret": "[a-z0-9+/_=.-]{12,}"}
#: A group of digits, as parts of numbers are written, and what may begin a grouped number besides.
_GROUP, _FIRST = re.compile(r"\(?[0-9][0-9.()/-]*\Z"), re.compile(r"(?:[A-Za-z]{2}|[+(]{0,2})[0-9][0-9.()/-]*\Z")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches: around each @, as far left as the last match lets, then the domain."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_SET:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, free := m.end()))
            at = text.find("@", free)
        else:
            free = max(free, at + 1)
            at = text.find("@", at + 1)
    return found


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(filter("0123456789".__contains__, text))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the four kinds, by kind and start; failing ones are dropped without another try."""
    spans = [("email", *s) for s in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        spans += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_byte, m.group().split(".")))]
        spans += [("card", *m.span()) for m in _CARD.finditer(text)
                  if 13 <= len(d := _digits(m.group())) <= 19 and _luhn(d)]
        if "+" in text:
            spans += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return spans


def candidates(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, int | None]]:
    """Other places that look like identifiers, outside the given spans: tokens of 6 characters or more with 4 digits or
    an @, and runs of digit groups, one blank between them, with 7 to 34 digits. A token in such a run has its start."""
    found, at, taken = [], 0, sorted((a, b) for _, a, b in spans)
    free = lambda start, end: not any(a < end and start < b for a, b in taken)
    run: list[tuple[int, int, str]] = []  # tokens as they stand in the text

    def close() -> None:
        whole = None
        if len(run) > 1:
            start, end = run[0][0], run[-1][0] + len(run[-1][2].rstrip(_EDGE))
            if 7 <= len(_digits(text[start:end])) <= 34 and free(start, end):
                whole = start
                found.append((start, end, None))
        for first, last, token in run:
            start = first + len(token) - len(token.lstrip(_EDGE))
            token = token.strip(_EDGE)
            end = start + len(token)
            if len(token) >= 6 and ("@" in token or len(_digits(token)) >= 4 or len(token) >= 20) and free(start, end):
                found.append((start, end, whole))
        run.clear()

    while m := _MARKED.search(text, at):
        start = max(text.rfind(" ", at, m.start()), text.rfind("\n", at, m.start()), at - 1) + 1
        ends = [e for e in (text.find(" ", m.start()), text.find("\n", m.start())) if e >= 0]
        end = at = min(ends, default=len(text))
        token = text[start:end]
        if not (run and start == run[-1][1] + 1 and text[start - 1] == " " and _GROUP.match(token.rstrip(_EDGE))
                and run[-1][2][-1] not in ",;:.!?" and _FIRST.match(run[0][2])):
            close()
        run.append((start, end, token))
    close()
    return found


def seed(text: str, start: int, end: int) -> str | None:
    """The kind beyond the base ones that a place certainly has."""
    value = text[start:end]
    joined = value.replace(" ", "")
    if _IBAN.match(joined) and int("".join(str(int(c, 36)) for c in joined[4:] + joined[:4])) % 97 == 1:
        return "iban"
    if _VALUE.match(value) and any(map(str.isdigit, value)) and any(map(str.isalpha, value)):
        n = Counter(value)
        bits = -sum(c / len(value) * math.log2(c / len(value)) for c in n.values())
        return "secret" if bits >= ENTROPY and _NAMED.search(text, max(0, start - 200), start) else None
    return None


def _beside(text: str, at: int, ahead: bool) -> list[str]:
    """The ``REACH`` words or signs before or behind a place, nearest last or first. Long ones stand for their digest."""
    width = 96
    while True:
        part = text[at:at + width] if ahead else text[max(0, at - width):at]
        found = _TOKEN.findall(part)
        if len(found) > REACH or len(part) < width:  # the outermost may be cut
            break
        width *= 4
    found = [x.lower() for x in (found[:REACH] if ahead else found[-REACH:])]
    return [x if len(x) <= TOKEN else hashlib.md5(x.encode()).hexdigest() for x in found]


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a place, signs kept: one to three words or signs before it, two or three behind it, and
    one and two before with the one behind."""
    before, after = _beside(text, start, False), _beside(text, end, True)
    patterns = [" ".join([*before[-k:], "_"]) for k in range(1, len(before) + 1)]
    patterns += [" ".join(["_", *after[:k]]) for k in range(2, len(after) + 1)]
    return patterns + [" ".join([*before[-k:], "_", after[0]]) for k in range(1, min(2, len(before)) + 1) if after]


def scan(docs: DataFrame) -> DataFrame:
    """Per row: base spans, their digest, and every place with its instance and patterns (unknown places: kind null)."""
    place = "struct<kind:string,first:long,last:long,run:long,instance:string,patterns:array<string>>"
    schema = (f"doc_id long, n array<long>, base_sha256 string, spans array<string>, places array<{place}>")
    arrow = pa.struct([("kind", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("run", pa.int64()),
                       ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, written, places = [], [], [], []
            for text in texts_of(batch.column(1)):
                spans = base_spans(text)
                written.append([f"{k}:{a}:{b}" for k, a, b in spans])
                digests.append(hashlib.sha256(",".join(written[-1]).encode()).hexdigest())
                counts.append([sum(k == kind for k, _, _ in spans) for kind in KINDS])
                all_places = [*((*s, None) for s in spans), *((seed(text, *c[:2]), *c) for c in candidates(text, spans))]
                places.append([{"kind": k, "first": a, "last": b, "run": r, "instance": text[a:b].lower(),
                                "patterns": contexts(text, a, b)} for k, a, b, r in all_places])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.list_(pa.int64())), pa.array(digests, pa.string()),
                 pa.array(written, pa.list_(pa.string())), pa.array(places, pa.list_(arrow))],
                ["doc_id", "n", "base_sha256", "spans", "places"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def bootstrap(edges: DataFrame) -> DataFrame:
    """Accepted patterns (``pattern``, ``kind``, ``confidence``) of the graph ``edges(pattern, instance, kind)``.

    A pattern's confidence for a kind is the weight of its known instances of that kind against theirs and what
    contradicts them: instances known as another kind, and unknown ones of another shape. An unknown instance of the
    kind's shape may be what is looked for and weighs ``UNKNOWN``. Patterns with ``LEAST_KNOWN`` known instances and
    ``CONFIDENCE`` are accepted; the instances they reach become known with that weight and count in the next round,
    until a round reaches none. The rounds are joins of the graph's tables.
    """
    graph = edges.select("pattern", "instance").distinct().checkpoint()
    known = edges.filter("kind IS NOT NULL").select("instance", "kind").distinct().withColumn("weight", F.lit(1.0)).checkpoint()
    against = {k: F.when(F.col("instance").rlike(f"^(?:{shape})$"), UNKNOWN).otherwise(1.0) for k, shape in SHAPES.items()}
    while True:
        rows = graph.join(known, "instance", "left")
        sums = rows.groupBy("pattern").agg(
            *[F.sum(F.when(F.col("kind") == k, F.col("weight"))).alias(f"w_{k}") for k in KINDS + MORE],
            *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS + MORE],
            *[F.sum(F.when(F.col("kind").isNull(), against[k]).when(F.col("kind") != k, F.col("weight"))).alias(f"a_{k}")
              for k in KINDS + MORE])
        kinds = F.explode(F.array(*[F.struct(
            F.lit(k).alias("kind"), F.col(f"n_{k}").alias("n"),
            (F.col(f"w_{k}") / (F.col(f"w_{k}") + F.coalesce(F.col(f"a_{k}"), F.lit(0.0)))).alias("confidence")) for k in KINDS + MORE]))
        accepted = sums.select("pattern", kinds.alias("k")).select("pattern", "k.*").filter(
            (F.col("n") >= LEAST_KNOWN) & (F.col("confidence") >= CONFIDENCE)).select("pattern", "kind", "confidence").checkpoint()
        new = (graph.join(accepted, "pattern").join(known.select("instance"), "instance", "left_anti")
               .groupBy("instance").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"),
                                        F.max("confidence").alias("weight"))).checkpoint()
        if new.isEmpty():
            return accepted
        known = known.unionByName(new).checkpoint()


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, counts of base matches, ``base_sha256``, ``spans`` (base and found), ``n_found``, ``n_all``.

    ``kind:start:end``, joined by commas in the order of the kinds (base, then ``MORE``), then by start; code points, end
    exclusive. Base matches and the certain instances of further kinds are the seeds; identifier-like tokens beside them
    are added under the kind of the best accepted pattern around them. ``n_found`` counts what is not a base match. Null is the empty text and has none; repeated rows are scanned each; an empty table gives an empty table.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    rows = scan(docs).checkpoint().withColumn("_row", F.monotonically_increasing_id())  # of fixed partitions
    places = rows.select("_row", F.explode("places").alias("p")).select("_row", "p.*")
    edges = places.withColumn("pattern", F.explode("patterns")).select("pattern", "instance", "kind")
    accepted = bootstrap(edges)
    found = (places.filter("kind IS NULL").select("_row", "first", "last", "run", F.explode("patterns").alias("pattern"))
             .join(accepted, "pattern").groupBy("_row", "first", "last", "run")
             .agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind")))
    found = found.unionByName(places.filter(F.col("kind").isin(*MORE)).select("_row", "first", "last", "run", "kind"))
    # tokens of a run that was found as a whole are no places by themselves
    of_run = Window.partitionBy("_row", F.coalesce("run", "first"))
    found = found.withColumn("_whole", F.max(F.col("run").isNull()).over(of_run)).filter("run IS NULL OR NOT _whole")
    added = found.groupBy(F.col("_row").alias("_of")).agg(
        F.collect_list(F.concat_ws(":", "kind", "first", "last")).alias("added"))  # places of one text
    order = {k: i for i, k in enumerate(KINDS + MORE)}
    rank = lambda s: F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.split_part(s, F.lit(":"), F.lit(1)))
    keyed = F.transform(F.concat("spans", F.coalesce("added", F.array().cast("array<string>"))),
                        lambda s: F.struct(rank(s).alias("k"), F.split_part(s, F.lit(":"), F.lit(2)).cast("long").alias("a"),
                                           s.alias("s")))
    return rows.join(added, F.col("_row") == F.col("_of"), "left").select(
        "doc_id", *[F.col("n")[i].alias(f"n_{k}") for i, k in enumerate(KINDS)], "base_sha256",
        F.array_join(F.transform(F.array_sort(keyed), lambda x: x["s"]), ",").alias("spans"),
        F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_found"),
        (F.size("spans") + F.coalesce(F.size("added"), F.lit(0))).cast("long").alias("n_all"))
