"""Per-document text statistics, and a Gaussian mixture that tells natural prose from lists, tables and junk.

The mixture is fitted by expectation-maximisation on the standardised statistics of all documents; every iteration is one
distributed pass that returns sufficient statistics only. Its components get their meaning from inspected examples.
"""

from __future__ import annotations

import random
import re
import warnings
from collections.abc import Iterable, Iterator
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamisol.session import materialise

#: Components, most iterations, least gain of the mean log likelihood, ridge on covariances, rows (about) that seed the means.
COMPONENTS, ITERATIONS, GAIN, RIDGE, SEED_ROWS = 24, 20, 2e-3, 0.08, 4_000

#: Squared distance, in a component's own units, up to which an example speaks for it.
NEAR = 40.0

STATISTICS = ["word_count", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words", "common_pairs", "repetition", "plain_words", "digit_share", "running_share", "label_lines"]
_LETTERS = re.compile(r"[^\W\d_]+")
_EDGES, _INNER = ".,;:!?()\"'«»„“”‘’…¿¡", str.maketrans("", "", "'’-")
_SYMBOL = re.compile(r"[^\w\s.,;:'\"\-()!?…“”‘’«»„¿¡–—]|_")
_DIGIT = re.compile(r"\d")
_LABEL = re.compile(r"^\s*(?:[-*•]|\d{1,3}[.)]|[a-z][.)]|[^\W\d_][\w ]{0,24}:\s)")
_END = tuple(".!?:;\"»”…)")


def _windows(n: int, size: int = 24) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive windows of about ``size`` of n tokens."""
    many = max(1, round(n / size))
    for k in range(many):
        yield n * k // many, n * (k + 1) // many


def statistics(text: str | None, common: list[frozenset[str]]) -> list[float]:
    """STATISTICS of one text, read whole; all zero for a null or blank one. ``common``: the frequent words of each language; the one that fits best counts."""
    if not text or not text.strip():
        return [0.0] * len(STATISTICS)
    tokens = text.split()
    letters = _LETTERS.findall(text.lower())
    n, m = len(tokens), max(1, len(letters))
    best = max(common, key=lambda s: sum(map(s.__contains__, letters)), default=frozenset())
    hits = list(map(best.__contains__, letters))
    symbols, digits = len(_SYMBOL.findall(text)), len(_DIGIT.findall(text))
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    cores = [x.strip(_EDGES) for x in text.lower().split()]
    plain = list(map(str.isalpha, cores))
    frequent = list(map(best.__contains__, cores))
    for i, core in enumerate(cores):
        if not plain[i]:
            inner = core.translate(_INNER).isalpha() if core else False
            plain[i] = inner
            frequent[i] = sum(map(best.__contains__, _LETTERS.findall(core))) if inner else 0
    running = 0
    for i, j in _windows(n):
        size = j - i
        if sum(frequent[i:j]) >= 0.12 * size and sum(plain[i:j]) >= 0.7 * size and len(set(tokens[i:j])) >= 0.55 * size:
            running += size
    pairs = list(zip(letters, letters[1:], strict=False))
    return [
        float(n),
        sum(map(len, tokens)) / n,
        symbols / len(text),
        sum(x.endswith(_END) for x in lines) / len(lines),
        sum(hits) / max(n, m),
        sum(map(and_, hits, hits[1:])) / max(1, len(pairs)),
        1 - sum(len(set(pairs[i:j])) for i, j in _windows(len(pairs), 150)) / max(1, len(pairs)),
        sum(plain) / n,
        digits / len(text),
        running / n,
        sum(_LABEL.match(x) is not None for x in lines) / len(lines),
    ]


def by_language(common_words: DataFrame) -> list[frozenset[str]]:
    """The frequent words of each language; a list of stated size, which goes to the driver and to every task."""
    by: dict[str, set[str]] = {}
    for r in common_words.select("lang", "word").filter("word is not null").collect():
        by.setdefault(r.lang or "", set()).add(r.word.lower())
    return [frozenset(by[k]) for k in sorted(by)]


def with_statistics(docs: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, STATISTICS...) of every row; one row per row of ``docs``, repeated rows included, extra columns ignored.

    ``common_words`` is a word list of stated size; it goes to the driver and to every task.
    """
    common = by_language(common_words)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [statistics(t, common) for t in b.column(1).to_pylist()]
            cols = zip(*rows, strict=True) if rows else [[]] * len(STATISTICS)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.float64()) for c in cols)], [key, *STATISTICS])

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(scan, f"{key} long, " + ", ".join(f"{s} double" for s in STATISTICS))


class Mixture:
    """Full-covariance Gaussian mixture over transformed, standardised statistics."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray, weights: np.ndarray, means: np.ndarray, covariances: np.ndarray):
        self.rounds, self.converged = 0, False
        self.centre, self.scale, self.weights, self.means, self.covariances = centre, scale, weights, means, covariances
        self.roots = np.linalg.cholesky(covariances)
        self.inverse = np.linalg.inv(self.roots)
        self.constant = np.log(weights) - np.log(np.diagonal(self.roots, axis1=1, axis2=2)).sum(1) - means.shape[1] / 2 * np.log(2 * np.pi)

    @staticmethod
    def transform(x: np.ndarray) -> np.ndarray:
        """The statistics but for the word count, which tells nothing of the kind of text: word length by its logarithm, the shares of symbols
        and digits by their square root, which spreads low ones, the others as they are."""
        x = np.maximum(np.asarray(x, float), 0)
        return np.column_stack([np.log1p(x[:, 1]), np.sqrt(x[:, 2]), x[:, 3:8], np.sqrt(x[:, 8]), x[:, 9:]])

    def standardised(self, x: np.ndarray) -> np.ndarray:
        return (self.transform(x) - self.centre) / self.scale

    def logs(self, z: np.ndarray) -> np.ndarray:
        return np.stack([c - 0.5 * (((z - m) @ r.T) ** 2).sum(1) for c, m, r in zip(self.constant, self.means, self.inverse, strict=True)], 1)

    def posterior(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        logs = self.logs(z)
        top = logs.max(1, keepdims=True)
        e = np.exp(logs - top)
        total = e.sum(1, keepdims=True)
        return e / total, (top + np.log(total))[:, 0]


def _sums(rows: DataFrame | np.ndarray, width: int, each) -> np.ndarray:
    """Sum over all rows of what ``each`` makes of a batch's matrix. Tasks' vectors are added up by position, so ``width`` numbers reach the driver, however many tasks there are."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for b in batches:
            if b.num_rows:
                total += each(np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], ["k", "v"])

    if isinstance(rows, np.ndarray):
        return each(rows) if len(rows) else np.zeros(width)
    out = np.zeros(width)
    for r in rows.select(*STATISTICS).mapInArrow(scan, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r.k] = r.v
    return out


def _initial(z: np.ndarray, k: int, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and covariances to begin with: the anchors and rows of the sample far from them and each other, leaving lone outliers
    aside; then a few rounds of k-means."""
    means = list(anchors[:k])
    near = np.min([((z - m) ** 2).sum(1) for m in means], 0)
    while len(means) < k:
        order = np.argsort(-near, kind="stable")
        means.append(z[order[min(len(order) - 1, len(order) // 250)]])
        near = np.minimum(near, ((z - means[-1]) ** 2).sum(1))
    means = np.stack(means)
    for _ in range(8):
        group = np.stack([((z - m) ** 2).sum(1) for m in means], 1).argmin(1)
        means = np.stack([z[group == j].mean(0) if (group == j).any() else means[j] for j in range(k)])
    share = np.bincount(group, minlength=k) + 1.0
    spread = np.stack([np.cov(z[group == j].T) if (group == j).sum() > z.shape[1] else np.zeros((z.shape[1], z.shape[1])) for j in range(k)])
    return share / share.sum(), means, spread + 0.1 * np.eye(z.shape[1])


def fit(rows: DataFrame | np.ndarray, key: str = "doc_id", common: list[frozenset[str]] | None = None) -> Mixture | None:
    """Expectation-maximisation over all rows with STATISTICS, or over a matrix of them; None for an empty table. Only the first means come from a sample of SEED_ROWS rows
    and from the inspected examples, one mean for each kind of them."""
    d = len(STATISTICS) - 1
    moments = _sums(rows, 1 + 2 * d, lambda x: np.concatenate([[len(x)], Mixture.transform(x).sum(0), (Mixture.transform(x) ** 2).sum(0)]))
    n = moments[0]
    if not n:
        return None
    centre = moments[1 : d + 1] / n
    scale = np.sqrt(np.maximum(moments[d + 1 :] / n - centre**2, 1e-4))
    if isinstance(rows, np.ndarray):
        seeds = rows[:SEED_ROWS]
    else:  # by a share of the hash values, so that every task sends its part only
        part = F.pmod(F.xxhash64(key, "word_count"), F.lit(1_000_000)) <= int(1_000_000 * min(1.0, SEED_ROWS / n))
        seeds = np.asarray(sorted(list(r) for r in rows.filter(part).select(*STATISTICS).collect()))
        seeds = seeds if len(seeds) else np.asarray([list(r) for r in rows.select(*STATISTICS).limit(1).collect()])
    z = (Mixture.transform(seeds) - centre) / scale
    kinds: dict[str, list[list[float]]] = {}
    for kind, t in examples():
        kinds.setdefault(kind, []).append(statistics(t, common or []))
    anchors = np.stack([(Mixture.transform(np.asarray(v)).mean(0) - centre) / scale for v in kinds.values()])
    # an anchor without any row near it would only be in the way
    near = _sums(rows, len(anchors), lambda x: np.array([((((Mixture.transform(x) - centre) / scale - m) ** 2).sum(1) < 4 * d).sum() for m in anchors], float))
    anchors = anchors[near > 0] if common else anchors[:0]
    k = min(COMPONENTS, len(np.unique(z.round(6), axis=0)))
    model = Mixture(centre, scale, *_initial(z, k, anchors if len(anchors) else z[[int(np.argmin((z**2).sum(1)))]]))
    before = -np.inf
    for round_ in range(1, ITERATIONS + 1):

        def step(x: np.ndarray, model: Mixture = model) -> np.ndarray:
            z = model.standardised(x)
            r, ll = model.posterior(z)
            return np.concatenate([r.sum(0), (r.T @ z).ravel(), *(((z * r[:, [j]]).T @ z).ravel() for j in range(k)), [ll.sum()]])

        s = _sums(rows, k + k * d + k * d * d + 1, step)
        mass = s[:k] + 1e-6
        means = s[k : k + k * d].reshape(k, d) / mass[:, None]
        spread = s[k + k * d : -1].reshape(k, d, d) / mass[:, None, None] - np.einsum("ki,kj->kij", means, means)
        spread = (spread + spread.transpose(0, 2, 1)) / 2 + RIDGE * np.eye(d)
        low = np.linalg.eigvalsh(spread)[:, 0]
        spread += np.maximum(0, RIDGE - low)[:, None, None] * np.eye(d)
        model = Mixture(centre, scale, mass / mass.sum(), means, spread)
        gain, before = s[-1] / n - before, s[-1] / n
        model.rounds, model.converged = round_, bool(gain < GAIN)
        if model.converged:
            break
    if not model.converged:
        warnings.warn(f"the mixture still gained {gain:.4f} in its round {model.rounds}", stacklevel=2)
    return model


#: The label of each kind of example.
LABELS = {"prose": "prose", **dict.fromkeys(("fields", "bullets", "aliases", "entries"), "list"), **dict.fromkeys(("bars", "columns", "csv", "markup"), "table"), **dict.fromkeys(("salad", "repetition", "noise", "menu", "json", "blob", "codes"), "junk")}

# Examples written after inspecting documents of each kind; the texts are made up.
_SENTENCES = {
    "en": "The reviewer compared the copy of the passport with the form before the end of the week. Once the letter was answered, the branch closed the file and the manager signed it without a remark. During the annual visit, a former partner described the ownership of the vessel, which the bank had not seen until then. "
    "Maria Lindqvist asked for two further invoices because the amount did not match the contract. The account received 14 credits totalling 5,310 EUR in March. No reply came from the consulate after the second reminder, although the customer had sent the certificate by registered mail. ",
    "fr": "Le gestionnaire a comparé la copie du passeport avec le formulaire avant la fin de la semaine. Une fois la lettre reçue, l'agence a fermé le dossier et la cliente a signé sans remarque. Lors de la visite annuelle, un ancien partenaire a décrit la propriété du navire. "
    "Maria Lindqvist (Lyon): le notaire a demandé deux autres factures au guichet. La banque a refusé le contrat malgré deux lettres. Le comité a relevé une adresse différente en dépit du certificat envoyé par courrier. ",
    "de": "Die Prüferin verglich die Kopie des Reisepasses mit dem Formular vor dem Ende der Woche. Nach der Antwort auf den Brief schloss die Filiale die Akte und der Leiter unterschrieb ohne Bemerkung. Der frühere Partner beschrieb die Beteiligung bei dem jährlichen Besuch. "
    "Maria Lindqvist (Kiel): der Notar verlangte zwei weitere Rechnungen am Schalter. Die Bank bestritt den Vertrag trotz zweier Schreiben. Der Ausschuss vermerkte eine andere Anschrift unter Vorbehalt einer Prüfung. ",
    "es": "El gestor comparó la copia del pasaporte con el formulario antes del viernes. Tras recibir la carta, la sucursal cerró el expediente y la clienta firmó sin reservas. Un antiguo socio describió la propiedad del buque en la visita anual. "
    "Maria Lindqvist (Vigo): el notario solicitó otras facturas en la ventanilla. El banco rechazó el contrato a pesar de dos cartas. El comité informó una dirección distinta después de un cambio de certificado. ",
}


def examples() -> list[tuple[str, str]]:
    """(kind, text): prose in several layouts and languages, lists, tables and junk; LABELS has the label of each kind."""
    out: list[tuple[str, str]] = []
    for s in _SENTENCES.values():
        words = s.split()
        lines = "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))
        half = s[: s.index(". ") + 1]
        out += [("prose", s.strip()), ("prose", half), ("prose", s.upper()), ("prose", re.sub(r"[.,]", "", s).lower()), ("prose", lines), ("prose", s.replace(". ", ".\n\n")), ("prose", s + "\n\n- passport\n- letter\n")]
        # function words with a content word here and there, drawn in no order
        draw = random.Random(len(s))
        every = sorted(set(_LETTERS.findall(s.lower())))
        small, large = [w for w in every if len(w) <= 4], [w for w in every if len(w) > 4]
        for share, n in ((0.6, 150), (0.7, 220), (0.8, 90), (0.7, 40)):
            out.append(("salad", " ".join(draw.choice(small if draw.random() < share else large) for _ in range(n)) + "." * (n % 4 // 2)))
        out.append(("repetition", " ".join(words[3:6] * 30)))
        noisy = "".join("#%|~^<>§_=01"[(i * 7 + ord(c)) % 12] if (i * 31 + ord(c) * 17) % 5 < 2 else c for i, c in enumerate(s))
        out.append(("noise", noisy))
    names = ["Anna Berg", "João Luz", "Omar Salin", "Ivo Petrin", "Mara Teller", "Nils Holm", "Aisha Noor", "Li Tan"]
    dates = [f"20{10 + i}-0{1 + i}-1{i}" for i in range(8)]
    out += [
        ("bars", "| name | country | score |\n|---|---|---|\n" + "\n".join(f"| {n} | IN | 0.{311 + 37 * i} |" for i, n in enumerate(names * 2))),
        ("columns", "\n".join(f"{d}      {48213 * (i + 1) % 999999}    0.{213 + 71 * i}   CODE{i}" for i, d in enumerate(dates * 2))),
        ("csv", "\n".join(f"{n};{d};{i * 17};0.{i}5;OPEN" for i, (n, d) in enumerate(zip(names * 2, dates * 2, strict=True)))),
        ("markup", "".join(f"<tr><td>{n}</td><td>Port</td><td>{d}</td></tr>\n" for n, d in zip(names * 2, dates * 2, strict=True))),
        ("fields", "\n".join(f"Full name: {n}\nRef: -0-\nListed on: {d}" for n, d in zip(names, dates, strict=True))),
        ("bullets", "\n".join(f"- {n}, Port, {d}" for n, d in zip(names * 2, dates * 2, strict=True))),
        ("bullets", "\n".join(f"{i + 1}. {n}" for i, n in enumerate(names * 2))),
        ("aliases", "; ".join(f"{n} (a.k.a. {m})" for n, m in zip(names * 3, names[3:] + names * 2 + names[:3], strict=True)) + "."),
        ("aliases", "; ".join(f"{n} (a.k.a. {m} {n})" for n, m in zip(names * 3, names[2:] + names * 2 + names[:2], strict=True)) + "."),
        ("entries", "\n".join(f"a) {n}, São Port, {d}." for n, d in zip(names * 2, dates * 2, strict=True))),
        ("menu", "\n".join(["Login", "Next page", "Contact", "Cookie settings", "Download list (PDF)", "A A A", "Home > Lists > Search"] * 8)),
        ("menu", "\n".join(["Contact", "Login", "A A A", "Next page"] * 14)),
        ("json", "[" + ", ".join(f'{{"id": {i * 7919}, "caption": "{n}", "score": 0.{153 + i}, "topics": ["x"]}}' for i, n in enumerate(names * 2)) + "]"),
        ("json", "[\n" + ",\n".join(f' {{\n  "id": {i * 7919},\n  "caption": "{n}",\n  "topics": [\n   "x"\n  ]\n }}' for i, n in enumerate(names * 2)) + "\n]"),
        ("blob", "".join(chr(65 + (i * i * 7 + i) % 26) + chr(97 + (i * 11) % 26) + str(i * 13 % 10) for i in range(300))),
        ("codes", " ".join(f"N/A -0- {i * 73391 % 999999} 0.{i * 137 % 9999} Q{i} NARC-K" for i in range(25))),
    ]
    return out


def labelled(model: Mixture, common: list[frozenset[str]]) -> list[str]:
    """The label of each component: what the examples that fall into it say, weighted by their posterior; for a component without any, the label
    of the example nearest to its mean, in units of the examples' own spread."""
    shown = [(LABELS[kind], t) for kind, t in examples()]
    x = Mixture.transform(np.asarray([statistics(t, common) for _, t in shown]))
    z = (x - model.centre) / model.scale
    post, _ = model.posterior(z)
    away = np.stack([(((z - m) @ r.T) ** 2).sum(1) for m, r in zip(model.means, model.inverse, strict=True)], 1)
    post = np.where(away <= NEAR, post, 0.0)
    kinds = ["prose", "list", "table", "junk"]
    votes = np.zeros((len(model.weights), len(kinds)))
    each = {k: sum(label == k for label, _ in shown) for k in kinds}
    for (label, _), p in zip(shown, post, strict=True):
        votes[:, kinds.index(label)] += p / each[label]
    spread, means = x.std(0) + 1e-3, model.means * model.scale + model.centre
    out = []
    for k in range(len(model.weights)):
        if votes[k].max() > 0.01:
            out.append(kinds[int(votes[k].argmax())])
        else:
            out.append(shown[int((((x - means[k]) / spread) ** 2).sum(1).argmin())][0])
    return out


def with_prose(rows: DataFrame, common: list[frozenset[str]], key: str = "doc_id") -> DataFrame:
    """``rows``, which have STATISTICS, with the column ``prose`` in place of these: the posterior of prose by a mixture fitted on all rows; 0 for blank texts."""
    model = fit(rows, key, common)
    prose = np.asarray([label == "prose" for label in labelled(model, common)], float) if model else None
    kept = [c for c in rows.columns if c not in STATISTICS]

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(b.schema.get_field_index(s)).to_numpy(zero_copy_only=False) for s in STATISTICS])
            share = np.where(x[:, 0] == 0, 0.0, model.posterior(model.standardised(x))[0] @ prose) if model and len(x) else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array(share)], [*kept, "prose"])

    return rows.mapInArrow(judge, ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n in kept) + ", prose double")


def classified(docs: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, STATISTICS..., label, prose): label is prose, list, table or junk; prose the posterior of prose. Blank texts are junk with prose 0."""
    rows = materialise(with_statistics(docs, common_words, key, text), "statistics")
    common = by_language(common_words)
    model = fit(rows, key, common)
    schema = f"{key} long, " + ", ".join(f"{s} double" for s in STATISTICS) + ", label string, prose double"
    if model is None:
        return docs.sparkSession.createDataFrame([], schema)
    labels = labelled(model, common)
    kinds = sorted(set(labels))
    member = np.asarray([[label == k for k in kinds] for label in labels], float)

    def decide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(STATISTICS))])
            post = model.posterior(model.standardised(x))[0] @ member if len(x) else np.zeros((0, len(kinds)))
            blank = x[:, 0] == 0
            prose = np.where(blank, 0.0, post[:, kinds.index("prose")] if "prose" in kinds else 0.0)
            label = np.where(blank, "junk", np.asarray(kinds)[post.argmax(1)]) if len(x) else np.asarray([], str)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(label.tolist(), pa.string()), pa.array(prose)], [*b.schema.names, "label", "prose"])

    return rows.mapInArrow(decide, schema)


def found(docs: DataFrame, common_words: DataFrame) -> DataFrame:
    return classified(docs, common_words).filter("label <> 'prose'").select("doc_id").distinct()
