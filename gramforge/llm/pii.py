"""Personal data by weak supervision.

Base patterns stand. Wider candidates of the same kinds and of names are voted on by labelers, for or against: strict
pattern, gazetteer (domains, given names, issuers, area codes, address blocks), context (cues in four languages as
whole words), shape (check digits, lengths, repeats) and surroundings. Counts of vote patterns over all documents give, by expectation-maximisation for each kind,
each labeler's reliability and each pattern's probability. These probabilities are the training labels of a logistic span
classifier, which sees no vote: its features are characters and word shapes within the span and the words around it,
hashed. So it goes beyond the labelers' lists: what stands where accepted spans stand is accepted as well.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramforge.llm.bytescan import slices
from gramforge.llm.runtime import ship_code, stored

KINDS = ("email", "ip", "card", "phone", "name")
BASE_KINDS = KINDS[:4]
#: Patterns of the base kinds, written so that none backtracks (possessive runs).
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Wider candidates.
WIDE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]+(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]+)+"),
    "phone": re.compile(r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[.\x20/-][0-9]{4}){3}(?![0-9])"),
    "ip": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "name": re.compile(r"\b(?:Mrs?|Ms|Dr|Prof|Herrn?|Frau|M(?=\.)|Mme|Mlle|Monsieur|Madame|Sra?|Srta|Señora?|Don|Doña)\.?\x20[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?:[\x20-][A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+){0,2}"),
}
#: One of these stands in every text with a name of the pattern above.
TITLES = ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "M.", "Mme", "Mlle", "Monsieur", "Madame", "Sr", "Señor", "Don", "Doña")
#: Top-level domains in use, frequent given names of the four languages, and how card numbers begin.
GAZETTEER = {
    "email": frozenset(
        "com org net edu gov mil int info biz name pro io dev app ai cloud online site shop tech blog example "
        "ac ad ae ar at au be bg bo br by ca ch cl cn co cr cu cy cz de dk do ec ee eg es eu fi fr gb gr gt hk hn hr hu id ie "
        "il in ir is it jp ke kr li lt lu lv ma mc md me mx my ng ni nl no nz pa pe ph pl pr pt py ro rs ru sa se sg si sk sv "
        "th tn tr tw ua uk us uy ve vn za".split()
    ),
    "name": frozenset(
        "james mary john patricia robert jennifer michael linda william elizabeth david barbara richard susan joseph jessica "
        "thomas sarah charles karen daniel lisa matthew nancy anthony betty mark margaret paul sandra steven ashley andrew "
        "emily george anna peter laura emma alice hans peter wolfgang klaus jürgen dieter manfred uwe günter stefan andreas "
        "ursula monika helga renate sabine ingrid petra gisela karin birgit jean pierre michel andré philippe alain jacques "
        "bernard louis marie nathalie isabelle sylvie catherine françoise monique nicolas julien camille chloé josé antonio "
        "juan manuel francisco luis javier miguel ángel carlos jesús maría carmen josefa isabel dolores pilar teresa ana "
        "lucía sofía pablo diego sergio".split()
    ),
    "card": ("4", "51", "52", "53", "54", "55", "2221", "23", "24", "25", "26", "270", "271", "2720", "34", "37", "35", "36", "38", "6011", "644", "645", "65", "62"),
}
#: Cues, as whole words before a candidate, in English, German, French and Spanish.
CONTEXT = {
    "email": "mail email e-mail contact write reply address kontakt schreiben adresse courriel écrire adresse correo escribir contacto",
    "ip": "ip host server address client from adresse rechner hôte serveur servidor dirección cliente",
    "card": "card visa mastercard amex credit debit payment paid karte kreditkarte zahlung carte paiement tarjeta pago crédito",
    "phone": "phone call tel telephone mobile cell fax contact telefon anrufen mobil handy rufnummer téléphone appeler portable teléfono llamar móvil",
    "name": "dear signed regards patient sincerely by from liebe lieber gruß unterschrift cher chère signé cordialement querido querida firmado atentamente",
}
AGAINST = "version v release isbn issn order invoice sku part serial figure fig table section chapter page build ticket bestellung rechnung artikel abbildung tabelle kapitel seite commande facture référence tableau chapitre pedido factura referencia figura tabla capítulo página"
_cue = lambda words: re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, dict.fromkeys(words.split()))) + r")(?!\w)")
CONTEXT_CUES = {k: _cue(v) for k, v in CONTEXT.items()}
AGAINST_CUES = _cue(AGAINST)
LABELERS = ("pattern", "gazetteer", "context", "shape", "surroundings")
BEFORE = 40
#: Buckets of the classifier's hashed features, words around a span that it looks at, its ridge and Newton steps.
BUCKETS, AROUND, RIDGE, STEPS = 1024, 3, 1.0, 20
#: Spans of each kind, base and wider ones each, that the classifier is fitted on at most, drawn by a hash.
FIT_SPANS = 1500
CANDIDATE = "struct<kind:int,start:int,end:int,base:boolean,votes:int,own:array<int>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) << (i & 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The base spans of each kind, leftmost first, in code points."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE_KINDS}
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            free = m.end()
            out["email"].append((begin, free))
        at = text.find("@", max(at + 1, free))
    for m in IP.finditer(text):
        if all(len(d := p.lstrip("0")) <= 3 and int(d or 0) <= 255 for p in m[0].split(".")):
            out["ip"].append(m.span())
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out["phone"].append(m.span())
    return out


def _votes(text: str, kind: str, start: int, end: int, base: bool) -> int:
    """Votes of the labelers, each 0 (against), 1 (none) or 2 (for), as one number to base 3."""
    body = text[start:end]
    digits = "".join(c for c in body if c in "0123456789")
    pattern, gazetteer, shape = (2 if base else 1), 1, 1
    if kind == "email":
        words = re.findall(r"[^\W\d_]+", body.lower())
        gazetteer = 2 if words and words[-1] in GAZETTEER["email"] else 0
        shape = 0 if len(body) > 254 or ".." in body else 2
    elif kind == "name":
        words = re.findall(r"[^\W\d_]+", body.lower())[1:]
        gazetteer = 2 if any(w in GAZETTEER["name"] for w in words) else 1
        pattern, shape = (2 if len(words) > 1 else 1), (0 if text[end : end + 1] == "'" else 1)
    elif kind == "card":
        gazetteer = 2 if digits.startswith(GAZETTEER["card"]) else 0
        shape = 2 if luhn(digits) and len(set(digits)) > 2 else 0
    elif kind == "phone":
        # an area code and an exchange begin with 2 to 9
        national = digits[-10:]
        gazetteer = 0 if len(digits) < 8 or len(set(digits)) < 3 else 2 if "+" in body or national[0] in "23456789" else 0
        shape = 2 if len(digits) >= 10 and (len(digits) != 10 or national[3] in "23456789") else 0
    elif ":" in body:
        groups = body.lower().split(":")
        gazetteer = 0 if groups[0] in ("0", "0000") else 2 if groups[0].startswith(("2", "fe8", "fc", "fd")) else 1
        shape = 2 if len(set(groups)) > 2 else 0
    else:
        parts = body.split(".")
        gazetteer = 0 if parts[0].lstrip("0") in ("", "127", "255") else 2
        shape = 0 if any(len(p) > 1 and p[0] == "0" for p in parts) or max(map(len, parts)) == 1 else 2
    before = text[max(0, start - BEFORE) : start].lower()
    context = 0 if AGAINST_CUES.search(before) else 2 if CONTEXT_CUES[kind].search(before) else 1
    glued = (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    votes = 0
    for v in (pattern, gazetteer, context, shape, 0 if glued else 2):
        votes = 3 * votes + v
    return votes


WORD = re.compile(r"\w+|[^\w\s]")
_RUNS = re.compile(r"(.)\1+")


def word_shape(word: str) -> str:
    """Capitals as A, other letters as a, digits as 9, runs of one of them once."""
    return _RUNS.sub(r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word))


def own_features(text: str, kind: str, start: int, end: int) -> list[int]:
    """Hashed features of a span, ascending: its shape, length, digits and character trigrams (digits as 9), the words and
    word shapes before and after it. None of them is a labeler's vote."""
    body = text[start:end]
    plain = "^" + re.sub("[0-9]", "9", body.lower()) + "$"
    digits = sum(c in "0123456789" for c in body)
    before = WORD.findall(text[max(0, start - BEFORE) : start].lower())[-AROUND:]
    after = WORD.findall(text[end : end + BEFORE].lower())[:AROUND]
    names = {"bias", f"shape {word_shape(body)}", f"size {min(8, (end - start) // 4)}", f"digits {digits}" if digits < 24 else "many digits"}
    names |= {f"tri {plain[i : i + 3]}" for i in range(len(plain) - 2)}
    names |= {f"before {w}" for w in before} | {f"after {w}" for w in after}
    names |= {f"last {before[-1] if before else ''}", f"next {after[0] if after else ''}"}
    names |= {f"left {word_shape(text[max(0, start - 1) : start])}", f"right {word_shape(text[end : end + 1])}"}
    return sorted({zlib.crc32(f"{kind} {n}".encode()) % BUCKETS for n in names})


def candidates(text: str) -> list[dict]:
    """Base spans and wider candidates that overlap none of them, with votes."""
    base = base_spans(text)
    found = [(KINDS.index(k), a, b, True) for k in BASE_KINDS for a, b in base[k]]
    taken = sorted((a, b) for _, a, b, _ in found)
    has_digit, has_title = any(c in text for c in "0123456789"), any(t in text for t in TITLES)
    for k, pattern in WIDE.items():
        if (k == "name" and not has_title) or (k in ("phone", "card", "ip") and not has_digit) or (k == "email" and "(" not in text and "[" not in text):
            continue
        own: list[tuple[int, int]] = []
        at = 0
        for m in pattern.finditer(text):
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            if at == len(taken) or taken[at][0] >= m.end():
                found.append((KINDS.index(k), *m.span(), False))
                own.append(m.span())
        taken = sorted(taken + own)
    out = []
    for k, a, b, is_base in sorted(found):
        out.append({"kind": k, "start": a, "end": b, "base": is_base, "votes": _votes(text, KINDS[k], a, b, is_base), "own": own_features(text, KINDS[k], a, b)})
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and `found`, the candidates of every row's whole text; null texts are empty."""
    ship_code(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.int32()), ("own", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "t"):
            yield pa.RecordBatch.from_arrays([piece.column("i"), pa.array([candidates(t or "") for t in piece.column("t").to_pylist()], kind)], names=["i", "found"])

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"i long, found array<{CANDIDATE}>")


def _digits(votes: np.ndarray) -> np.ndarray:
    return np.stack([votes // 3 ** (len(LABELERS) - 1 - j) % 3 for j in range(len(LABELERS))], axis=1)


class SpanModel:
    """Reliabilities by expectation-maximisation over counted vote patterns, kind by kind, and the classifier whose training
    labels they give."""

    def __init__(self, rows: list[tuple[int, int, int]], spans: list[tuple[int, int, list[int]]] = (), rounds: int = 60):
        """rows: (kind, votes, count), at most kinds * 3^labelers of them; spans: (kind, votes, features) to fit on."""
        #: two rows a kind: of what is no personal data, of what is; labeler; vote
        self.reliability = np.full((2 * len(KINDS), len(LABELERS), 3), 1 / 3)
        self.prior = np.full(len(KINDS), 0.5)
        for k in range(len(KINDS)):
            own = np.array(sorted((v, n) for kind, v, n in rows if kind == k), np.float64).reshape(-1, 2)
            if len(own):
                self._reliabilities(k, _digits(own[:, 0].astype(int)), own[:, 1], rounds)
        self.weights = self._fitted(list(spans)) if len(spans) else None

    def _reliabilities(self, k: int, v: np.ndarray, n: np.ndarray, rounds: int) -> None:
        p = 1 / (1 + np.exp(((v == 0).sum(1) - (v == 2).sum(1)).astype(float)))
        for _ in range(rounds):
            self.prior[k] = (n @ p + 1) / (n.sum() + 2)
            for c, weight in enumerate((n * (1 - p), n * p)):
                for j in range(len(LABELERS)):
                    seen = np.bincount(v[:, j], weights=weight, minlength=3) + np.array([[2, 1, 0.5], [0.5, 1, 2]][c])
                    self.reliability[2 * k + c, j] = seen / seen.sum()
            p = self.probability(np.full(len(v), k), v)

    def probability(self, kind: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Of votes of spans (one row each), by the labelers' reliabilities."""
        log = np.log(self.prior[kind]) - np.log1p(-self.prior[kind])
        for j in range(len(LABELERS)):
            log = log + np.log(self.reliability[2 * kind + 1, j, v[:, j]] / self.reliability[2 * kind, j, v[:, j]])
        return 1 / (1 + np.exp(-log.clip(-50, 50)))

    def _fitted(self, spans: list[tuple[int, int, list[int]]]) -> np.ndarray:
        kind, votes = (np.array([s[c] for s in spans], int) for c in (0, 1))
        p = self.probability(kind, _digits(votes))
        x = np.zeros((len(spans), BUCKETS))
        for i, s in enumerate(spans):
            x[i, s[2]] = 1
        w = np.zeros(BUCKETS)
        for _ in range(STEPS):  # Newton steps on the log loss with a ridge
            q = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
            step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + RIDGE * np.eye(BUCKETS), x.T @ (p - q) - RIDGE * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        return w

    def accepts(self, found: list[dict]) -> list[bool]:
        if self.weights is None:
            return [False] * len(found)
        return [bool(self.weights[c["own"]].sum() >= 0) for c in found]


def fit(seen: DataFrame, spans: int = FIT_SPANS) -> SpanModel:
    """The model of scanned rows (i, found): vote patterns of all candidates are counted, the classifier is fitted on at most
    `spans` of each kind, base and wider ones each, by the least hashes of id, place and features; repeated rows count
    once there. The driver gets the patterns and about twice those spans."""
    each = seen.select("i", F.inline("found")).withColumn("h", F.pmod(F.xxhash64("i", "start", "votes", "own"), F.lit(1 << 40)))
    counted = each.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect()
    sizes = each.groupBy("kind", "base").agg(F.approx_count_distinct("h", 0.05).alias("n")).collect()
    if not sizes:
        return SpanModel([])
    share = F.create_map(*[F.lit(x) for r in sizes for x in (2 * r.kind + int(r.base), min(1.0, 2 * spans / r.n))])
    stratum = 2 * F.col("kind") + F.col("base").cast("int")
    drawn = each.filter(F.col("h") < F.element_at(share, stratum) * (1 << 40)).groupBy("kind", "base", "h").agg(F.first("votes").alias("votes"), F.first("own").alias("own")).collect()
    held: dict[tuple, list] = {}
    for r in sorted(drawn, key=lambda r: (r.kind, r.base, r.h)):
        held.setdefault((r.kind, r.base), []).append((r.kind, r.votes, r.own))
    return SpanModel([tuple(r) for r in counted], [x for own in held.values() for x in own[:spans]])


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: the id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Spans are in code points, by kind, then start. Null and empty texts have none; repeated rows are alike; without any
    candidate in the table nothing is learned and nothing added; texts of any length are taken whole, other columns are
    left out, an empty table gives no rows. The texts are read once: candidates with votes and
    features go to the shared folder, their pattern counts (bounded by the number of patterns) and the spans to fit on
    (bounded by FIT_SPANS) to the driver.
    """
    seen = stored(scan(docs, id_col, text_col), "candidates")
    held = docs.sparkSession.sparkContext.broadcast(fit(seen))
    counts = [f"n_{k}" for k in BASE_KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            rows = []
            for found in batch.column("found").to_pylist():
                if not found:
                    rows.append((0, 0, 0, 0, empty, ""))
                    continue
                base = [(c["kind"], c["start"], c["end"]) for c in found if c["base"]]
                wide = [c for c in found if not c["base"]]
                added = [(c["kind"], c["start"], c["end"]) for c, yes in zip(wide, held.value.accepts(wide), strict=True) if yes]
                n = Counter(k for k, _, _ in base)
                rows.append((n[0], n[1], n[2], n[3], hashlib.sha256(spans_text(base).encode()).hexdigest(), spans_text(base + added)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("i"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=[id_col, *counts, "base_sha256", "spans"]) if rows else pa.RecordBatch.from_arrays([batch.column("i"), *(pa.array([], t) for t in kinds)], names=[id_col, *counts, "base_sha256", "spans"])

    return seen.mapInArrow(run, f"`{id_col}` long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
