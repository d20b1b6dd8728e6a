"""Template residue, filler, error pages and script notices in place of content (problem 10).

Texts are cut into units (sentences and lines). Two regularised logistic regressions score units
by hashed n-grams of words and of the shapes around symbols, by length and by title features: one
knows unfilled placeholders, the other units that are filler, an error message or a notice. They
are trained on weak labels (response-status lines and known phrases), checked on hosts that
training never saw, and their weights are broadcast. A document is residue if one unit holds a
placeholder, or if nearly all of its words stand in residue units.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Collection, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiverlake.operators.sampling import hashed_sample

#: Documents that training takes at most, and the longest of them in characters.
MAX_TRAIN_DOCS = 12_000
MAX_TRAIN_CHARS = 20_000
#: Part of the hosts that is held out for validation, in percent.
HELD_OUT = 20
#: log2 of the number of weights.
BITS = 18
#: Times that the words of filler text are looked for.
GROWTH_STEPS = 4
#: Part of a document's words that must stand in residue units.
RESIDUE_SHARE = 0.7
#: Score from which a unit holds a placeholder; below 0, as a missed one costs more than a false one.
PLACEHOLDER_CUT = -1.0

# Weak labels. Phrases in normal form (see normal), by kind.
ERROR_PHRASES = (
    "page not found|we can t find the page you re looking for|go back to the home page|http error 0|the requested resource is not available|"
    "internal server error|the server was unable to complete your request|please try again later|access denied|you do not have permission to view this page|"
    "an error occurred while processing your request|we re sorry something went wrong on our end|something went wrong|fatal error|uncaught exception|"
    "exception in thread|nullpointerexception|traceback most recent call last|keyerror|could not open the connection to the database|"
    "the upstream server closed the connection|too many requests|slow down and retry|your session has expired|please log in again|"
    "this site is down for maintenance|we are checking your browser|you will be forwarded soon|sorry this content is no longer available in your area|"
    "oops|service temporarily unavailable|gateway timeout|bad gateway|"
    "page introuvable|la page demandee n existe plus|erreur interne du serveur|veuillez reessayer plus tard|acces refuse|vous n avez pas le droit d afficher cette page|"
    "une erreur est survenue|votre session a expire|site en maintenance|"
    "pagina no encontrada|la pagina solicitada ya no existe|error interno del servidor|intentelo de nuevo mas tarde|acceso denegado|no tiene permiso para ver esta pagina|"
    "se produjo un error inesperado|su sesion ha caducado|sitio en mantenimiento|"
    "seite nicht gefunden|die angeforderte seite existiert leider nicht mehr|interner serverfehler|bitte versuchen sie es spater erneut|zugriff verweigert|"
    "sie haben keine berechtigung fur diese seite|es ist ein unerwarteter fehler aufgetreten|bitte melden sie sich erneut an|ihre sitzung ist abgelaufen|"
    "wegen wartungsarbeiten vorubergehend nicht erreichbar"
).split("|")
_SCRIPT = r"(?:java ?script|js|scripts?|scripting|skripte)"
NOTICE_PATTERNS = [
    rf"(?:enable|activate|switch on|turn on) {_SCRIPT}",
    rf"{_SCRIPT} (?:is|are) (?:disabled|required|turned off)",
    rf"(?:not support|without|needs|requires) {_SCRIPT}",
    r"turn it on in your browser settings",
    r"some features will not work",
    rf"(?:activer|sans) {_SCRIPT}",
    rf"{_SCRIPT} est (?:desactive|requise?|necessaire)",
    rf"execution de {_SCRIPT} est requise",
    rf"(?:active|necesita|habilite|permitir los|sin) {_SCRIPT}",
    rf"{_SCRIPT} esta desactivado",
    rf"(?:aktivieren sie|ohne|nur mit) {_SCRIPT}",
    rf"{_SCRIPT} ist in ihrem browser",
]
FILLER_PHRASES = (
    "type your text here|your headline goes here|this is sample text|dummy paragraph|add a description of your product in this box|"
    "placeholder copy to be replaced later|text goes in this spot|your text here|"
    "texto provisional se cambiara|escriba aqui su texto|aqui va su titulo|texto de ejemplo para la maqueta|este es un texto de relleno|"
    "saisissez votre texte ici|ceci est un texte de remplissage|votre titre ici|texte provisoire a remplacer|faux texte pour la maquette|"
    "dies ist ein platzhalter|hier steht ihre uberschrift|mustertext fur die vorschau|hier folgt bald inhalt|bitte hier text eingeben|blindtext blindtext|"
    "tbd tbd|foo bar baz|blah blah blah|qwertz qwertz|qwerty qwerty|asdf jklo|asdf asdf|abc abc abc|text text text"
).split("|")
#: Fixed value: the printers' filler text in its common form. Garbled forms are for the model to learn.
LATIN = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation "
    "ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint "
    "occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum"
).split()
#: Markup tags, which are no placeholders.
TAGS = "a b i p s u br em hr li ol td th tr ul img pre div code head html span table strong style script noscript h1 h2 h3 h4 h5 h6".split()
#: A status code with its standard reason, standing alone.
STATUS = re.compile(r"^\W*(?:http )?(?:error |fehler |erreur )?0 *(?:page not found|not found|forbidden|gateway timeout|bad gateway|unauthorized|gone|bad request|service (?:temporarily )?unavailable|internal server error|page introuvable|pagina no encontrada|seite nicht gefunden)\b")
_ID = r"[A-Za-z_][A-Za-z0-9_.]*"
PLACEHOLDER = re.compile(
    "|".join(
        [
            rf"\{{\{{+ *{_ID}(?: *\|[^{{}}]*)? *\}}+",
            rf"\{{[%#] *[^{{}}]*? *[%#]\}}",
            rf"[$#!]?\{{!?{_ID}\}}",
            r"\$[A-Z][A-Z_]+\b\$?",
            r"%[A-Z][A-Z_]+%|%\([a-z_]+\)[sd]|%\d\$[sd]",
            r"<[%?][^<>]*[%?]>|<\?php[^<>]*\?>",
            rf"<<{_ID}>>|&lt;{_ID}&gt;",
            rf"<(?!(?:{'|'.join(TAGS)})>){_ID}>",
            r"__[A-Z][A-Z_]*__|@@[A-Z][A-Z_]*@@|##[A-Z][A-Z_]*##|\*\|[A-Z_]+\|\*|~[A-Z][A-Z_]*~",
            rf"\[\[{_ID}\]\]",
            r"\[(?:INSERT|Insert|insert|Your|YOUR|your|TODO|votre|su|inserte|Ihr|Ihre)\b[^\[\]]*\]|\[\w+ (?:einsetzen|aqui|aquí)\]",
            r"\[object Object\]",
        ]
    )
)

_TAG = re.compile(rf"</?(?:{'|'.join(TAGS)})(?: [^<>]*)?/?>|<\|\w+\|>", re.I)
_UNIT = re.compile(r"(?<=[.!?…。？！])[\s\"'”»“]+|\n+")
_TOKEN = re.compile(r"[^\W_]+(?:_[^\W_]+)*|[^\w\s]|_+|\s+")
_FORMAT = re.compile(r"[­​-‏‪-‮⁠-⁤﻿]")
_LETTERS = re.compile(r"[^\W\d_]+|0")
_DIGITS = re.compile(r"\d+")
_COMBINING = re.compile("[" + "".join(chr(c) for c in range(0x300, 0x20F1) if unicodedata.combining(chr(c))) + "]")
_REFERENCE = re.compile(r"^(?:reference|ref)\b")
_FIELD = re.compile(r"[A-Za-z_]")
#: Symbols that start or end a span of which the shape is taken.
_MARKS = frozenset("{}[]<>$%#@~*|&;_=?!")
_MARK = re.compile("[" + re.escape("".join(sorted(_MARKS))) + "]")


def normal(text: str) -> str:
    """Letter case, accents and digits' values removed, other symbols as one blank."""
    t = text.lower() if text.isascii() else _COMBINING.sub("", unicodedata.normalize("NFKD", text.casefold()))
    return " ".join(_LETTERS.findall(_DIGITS.sub("0", t)))


def units(text: str) -> list[str]:
    """Sentences and lines without markup tags, control tokens and invisible characters."""
    return [u for u in (x.strip() for x in _UNIT.split(_FORMAT.sub("", _TAG.sub(" ", text)))) if u]


def _alternatives(phrases: Iterable[str]) -> re.Pattern:
    return re.compile(r"\b(?:" + "|".join(phrases) + r")\b")


_PHRASES = _alternatives([*ERROR_PHRASES, *FILLER_PHRASES, *NOTICE_PATTERNS])
_LATIN = frozenset(w for w in LATIN if len(w) > 3)
_OPENING = frozenset(LATIN[:2])


def repeats(ws: list[str]) -> float:
    """Words a distinct word."""
    return len(ws) / max(1, len(set(ws)))


def _mostly(ws: list[str], known: Collection[str], share: float) -> bool:
    return (n := sum(w in known for w in ws)) >= 3 and n >= share * len(ws)


def filler_words(samples: list[list[str]]) -> frozenset[str]:
    """The words of filler text in a corpus: those of LATIN, and by steps those that stand in filler
    in most of their units. samples: the words of each unit. At first a unit with one of the two
    opening words of LATIN is filler, then one of which most words are known to be filler."""
    known: Collection[str] = _LATIN
    for step in range(GROWTH_STEPS):
        seen: Counter = Counter()
        inside: Counter = Counter()
        for ws in samples:
            (inside if (_mostly(ws, known, 0.5) if step else not _OPENING.isdisjoint(ws)) else seen).update(set(ws))
        least = 0.6 if step else 0.4  # not all filler has an opening word
        known = _LATIN | {w for w, n in inside.items() if n >= 3 and n >= least * (n + seen[w])}
    return frozenset(known)


def weak_labels(unit: str, phrases: re.Pattern = _PHRASES, filler_words: Collection[str] = _LATIN, t: str | None = None) -> tuple[bool, bool]:
    """(holds a placeholder, is residue) by pattern, phrase and status line. t: the unit in normal
    form, if at hand."""
    t = normal(unit) if t is None else t
    ws = t.split()
    filler = not ws and len(unit) >= 7 or len(ws) >= 4 and repeats(ws) >= 3 or _mostly(ws, filler_words, 0.6)
    return bool(PLACEHOLDER.search(unit)), bool(filler or STATUS.match(t) or (len(ws) <= 12 and _REFERENCE.match(t)) or phrases.search(t))


def _shape(token: str) -> str:
    if token.isspace():
        return " "
    if token.isdigit():
        return "0"
    if token.lower() in _KNOWN:
        return token.lower()
    if token[0] == "_" or not _FIELD.match(token):
        return token
    if len(token) == 1:
        return "l"
    return "W" if token.isupper() else "w"


#: Words that shapes keep.
_KNOWN = frozenset("insert here your todo votre ici einsetzen object php echo if upper lt gt s d".split()) | frozenset(t for t in TAGS if len(t) > 1)


@functools.lru_cache(1 << 16)
def _hashed(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def features(unit: str, place: int, n_units: int, t: str | None = None) -> tuple[list[int], list[int], list[int]]:
    """Hashed features of a unit: for the placeholder model, and for the residue model those of
    its wording and those of its length and place."""
    mask = (1 << BITS) - 1
    # Spans start at symbols: a unit without one has none, whatever its words are.
    shapes = [_shape(t) for t in _TOKEN.findall(unit)] if _MARK.search(unit) else []
    holes = set()
    for i, s in enumerate(shapes):
        if s in _MARKS or s[0] in "_@":
            # Spans that start and end at symbols, and the symbol with what follows.
            for j in range(i + 1, min(i + 13, len(shapes))):
                if j == i + 1 or shapes[j] in _MARKS or shapes[j][0] == "_":
                    holes.add(zlib.crc32("\x01".join(shapes[i : j + 1]).encode("utf-8", "surrogatepass")) & mask)
    ws = (normal(unit) if t is None else t).split()
    says = {_hashed(w) for w in ws}
    says.update(zlib.crc32(f"{a} {b}".encode()) & mask for a, b in zip(ws, ws[1:]))
    outer = [f"len{min(9, len(ws).bit_length())}"]
    extra = [f"rep{min(6, int(repeats(ws)))}"]
    if place == 0:
        outer.append("title" if unit[-1:] not in ".!?" else "first")
        outer.append("only" if n_units == 1 else "more")
    if not ws:
        extra.append("symbols" + str(min(3, len(unit) // 4)))
    says.update(_hashed(f"\x02{x}") for x in extra)
    return list(holes), list(says), [_hashed(f"\x02{x}") for x in outer]


@dataclass
class Model:
    """Weights and biases of both regressions, and their scores on held-out hosts."""

    holes: np.ndarray
    hole_bias: float
    says: np.ndarray
    say_bias: float
    held_out: dict[str, float]

    def residue(self, features: tuple[list[int], list[int]]) -> bool:
        """Whether a unit is residue by the features of its wording and of its length and place; the
        latter alone say nothing."""
        wording = float(self.says[features[0]].sum())
        return wording > 0 and wording + float(self.says[features[1]].sum()) + self.say_bias > 0

    def judge(self, text: str | None) -> tuple[float, float]:
        """(largest placeholder score of a unit, part of the words in residue units)."""
        if not text or not text.strip():
            return -99.0, 0.0
        us = units(text)
        most, inside, total = -99.0, 0, 0
        for k, u in enumerate(us):
            h, s, o = features(u, k, len(us))
            if h:
                most = max(most, float(self.holes[h].sum()) + self.hole_bias)
            n = max(1, len(u.split()))
            total += n
            if self.residue((s, o)):
                inside += n
        return most, inside / max(1, total)


def _fit(rows: list[list[int]], labels: np.ndarray, epochs: int = 8, l2: float = 1e-6, seed: int = 1) -> tuple[np.ndarray, float]:
    """Logistic regression by AdaGrad on small batches, L2-regularised."""
    n = len(rows)
    w, g2 = np.zeros(1 << BITS, np.float64), np.full(1 << BITS, 1e-2)
    bias, b2 = 0.0, 1e-2
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    flat = np.concatenate([np.asarray(r, np.int64) for r in rows]) if n else np.zeros(0, np.int64)
    rare = min(20.0, max(1.0, (n - labels.sum()) / max(1.0, labels.sum())))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, 256):
            pick = order[at : at + 256]
            sizes = offsets[pick + 1] - offsets[pick]
            idx = flat[np.repeat(offsets[pick] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())]
            row = np.repeat(np.arange(len(pick)), sizes)
            z = np.bincount(row, w[idx], len(pick)) + bias
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[pick]) * np.where(labels[pick] > 0, rare, 1.0)
            u, inv = np.unique(idx, return_inverse=True)
            grad = np.bincount(inv, err[row]) + l2 * n * w[u]
            g2[u] += grad * grad
            w[u] -= 0.5 * grad / np.sqrt(g2[u])
            gb = err.sum()
            b2 += gb * gb
            bias -= 0.5 * gb / b2**0.5
    return w.astype(np.float32), float(bias)


def _seed_units(phrases: re.Pattern) -> list[str]:
    """The phrases of the weak labels as units of their own, so that a small corpus trains too."""
    script = ["Please enable {}.", "{} is disabled in your browser.", "This page needs {}.", "Ce site ne fonctionne pas sans {}.", "Active {} para ver esta página.", "Este sitio necesita {} para funcionar.", "Bitte aktivieren Sie {}, um diese Seite anzuzeigen.", "Diese Seite funktioniert nur mit {}.", "Veuillez activer {} pour afficher cette page.", "{} est désactivé dans votre navigateur.", "{} está desactivado en su navegador.", "{} ist in Ihrem Browser ausgeschaltet."]
    said = [p + "." for p in [*ERROR_PHRASES, *FILLER_PHRASES] if phrases.search(p)] + [s.format(x) for s in script for x in ("JavaScript", "scripts", "scripting", "JS")]
    said += [f"{c} – {r}" for c in (403, 404, 500, 502, 503) for r in ("Forbidden", "Not Found", "Page not found", "Gateway Timeout", "Service Temporarily Unavailable")]
    said += [" ".join([w] * n) for w in ("abc", "text", "xxx", "blah", "......", "---") for n in (4, 8, 16)] + [" ".join(LATIN[i : i + n]).capitalize() + "." for n in (6, 9) for i in range(0, len(LATIN) - n, 2)]
    fields = ["first_name", "Price", "CITY", "orderId", "x"]
    holes = ["{{%s}}", "{{ %s }}", "{{{%s}}}", "{{ user.%s | upper }}", "${%s}", "${{%s}}", "#{%s}", "{%s}", "{!%s}", "{# %s #}", "{%% if %s %%}", "<%%= %s %%>", "<?php echo $%s; ?>", "<%s>", "<<%s>>", "&lt;%s&gt;", "[[%s]]", "%%(%s)s", "[Your %s]", "[INSERT %s HERE]", "[TODO: %s]", "[votre %s ici]", "[%s einsetzen]"]
    caps = ["%%%s%%", "$%s", "$%s$", "__%s__", "@@%s@@", "*|%s|*", "~%s~"]
    filled = [h % f for h in holes for f in fields] + [h % f for h in caps for f in ("NAME", "ORDER_ID", "CITY")] + ["%1$s", "%2$s", "[object Object]"]
    plain = ["The set {1, 2, 3} holds three numbers.", "See [12] and [sic].", "It costs $5 or 20% less.", "For x < 3 and y > 7 the rule fails [4].", "The path {upper branch} was not found.", "Write to A @ B, box #1.", "A text with <s> inside.", "page 404 of the book is lost.", "An essay about JavaScript and its error 404.", "She explains how scripts came to town.", "Printers once used lorem ipsum to show how a typeface looks."]
    return said + [f"Dear {x}, the wheel warms the shelf." for x in filled] + plain * 5


def train(docs: DataFrame, max_docs: int = MAX_TRAIN_DOCS, phrases: re.Pattern = _PHRASES) -> Model:
    """Fit both regressions on a bounded sample: the max_docs documents of at most MAX_TRAIN_CHARS
    characters with the smallest hashes. Hosts (source) whose hash falls below HELD_OUT percent
    only validate."""
    own = docs.where(F.length(F.trim("text")).between(1, MAX_TRAIN_CHARS)).select("text", F.coalesce(F.col("source"), F.lit("")).alias("source"), "doc_id")
    sample = hashed_sample(own, max_docs).collect()
    holes, says, yh, ys, out = [], [], [], [], []
    seeds = _seed_units(phrases)
    cut = []  # (unit, normal form, place, number of units, held out)
    for text, source in [(s, None) for s in seeds] + [(r[0], r[1]) for r in sample]:
        us = [text] if source is None else units(text)
        held = source is not None and zlib.crc32(source.encode()) % 100 < HELD_OUT
        cut += [(u, normal(u), k, len(us), held) for k, u in enumerate(us)]
    latin = filler_words([ws for _, t, _, _, _ in cut if len(ws := t.split()) >= 3])
    for u, t, k, n, held in cut:
        h, s, o = features(u, k, n, t)
        a, b = weak_labels(u, phrases, latin, t)
        holes.append(h)
        says.append(s + o)
        yh.append(a)
        ys.append(b)
        out.append(held)
    held, yh, ys = np.array(out), np.array(yh, np.float64), np.array(ys, np.float64)
    fit, test = np.flatnonzero(~held), np.flatnonzero(held)
    wh, bh = _fit([holes[i] for i in fit], yh[fit])
    ws, bs = _fit([says[i] for i in fit], ys[fit])
    scores: dict[str, float] = {"units": float(len(test)), "hosts_train_units": float(len(fit))}
    for name, w, b, x, y in (("placeholder", wh, bh, holes, yh), ("residue", ws, bs, says, ys)):
        said = np.array([bool(x[i]) and float(w[x[i]].sum()) + b > 0 for i in test], bool)
        true = y[test] > 0
        scores |= {f"{name}_precision": float((said & true).sum() / max(1, said.sum())), f"{name}_recall": float((said & true).sum() / max(1, true.sum())), f"{name}_cases": float(true.sum())}
    return Model(wh, bh, ws, bs, scores)


def unseen_phrases(docs: DataFrame, max_docs: int = MAX_TRAIN_DOCS, fold: int = 5) -> dict[str, float]:
    """How well residue is found whose wording no label names: the phrases with numbers divisible by
    fold are left out of the labels (the seeds included), and units that only they name, of all hosts,
    are judged: their number and the part found."""
    every = [*ERROR_PHRASES, *FILLER_PHRASES, *NOTICE_PATTERNS]
    hidden, kept = _alternatives(every[::fold]), _alternatives([p for i, p in enumerate(every) if i % fold])
    model = train(docs, max_docs, kept)
    own = docs.where(F.length(F.trim("text")).between(1, MAX_TRAIN_CHARS)).select("text", F.coalesce(F.col("source"), F.lit("")).alias("source"), "doc_id")
    n = found = 0
    for text, _, _ in hashed_sample(own, max_docs).collect():
        us = units(text)
        for k, u in enumerate(us):
            t = normal(u)
            if hidden.search(t) and not weak_labels(u, kept, t=t)[1]:
                n += 1
                found += model.residue(features(u, k, len(us), t)[1:])
    return {"unseen_phrase_units": float(n), "unseen_phrase_recall": found / max(1, n)}


def judge_residue(docs: DataFrame, model: Model, residue_share: float = RESIDUE_SHARE) -> DataFrame:
    """(doc_id, placeholder, residue) of each row, both as flags.

    Null, empty and blank texts are neither. Further columns are ignored, repeated rows are
    judged alike, an empty table gives no rows. The model has a fixed size and is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            seen = [m.judge(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h > PLACEHOLDER_CUT for h, _ in seen], pa.bool_()), pa.array([r >= residue_share for _, r in seen], pa.bool_())], names=["doc_id", "placeholder", "residue"])

    fields = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("placeholder", T.BooleanType()), T.StructField("residue", T.BooleanType())])
    return docs.select("doc_id", "text").mapInArrow(run, fields)


def residue_documents(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id of the documents to leave out; see judge_residue."""
    return judge_residue(docs, model or train(docs)).where("placeholder OR residue").select("doc_id")
