"""Secret scans with character Markov models.

Order-1 character models are compared by their log-likelihood ratio. Random strings have one model for each
usual alphabet, from a labelled sample of TRAIN_STRINGS strings that a seeded generator draws over them
(a token counts by the alphabet that suits it best; one model of all would underrate narrow ones).
Ordinary tokens have three: one from a labelled sample of identifiers (the names in the standard modules
of NAMED_IN), one from drawn numbers and dates, and one from the character transitions of every word of
every document, with 1 and PRIOR transitions of the first in each row; a token counts by the one that suits it best. Tokens of MIN_LENGTH
or more characters whose ratio (summed over the token, so that short ones need more a character) reaches
THRESHOLD become spans of kind `random`, beside the base kinds.

Cases: a null text is empty and has no spans. Texts and tokens of any length are scanned whole. A null
doc_id passes through. Repeated rows are answered each and count each in the model of the corpus. Other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import importlib
import inspect
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import keyed, text_slices, texts
from loomgraph.llm.shingles import utf8
from loomgraph.llm.spans import SECRETS, Taken, joined, sha256

MIN_LENGTH, THRESHOLD = 16, 8.0
TRAIN_STRINGS, PRIOR = 20_000, 1000.0
#: Standard modules whose names are the labelled sample of ordinary identifiers.
NAMED_IN = "argparse ast asyncio base64 calendar codecs collections configparser contextlib csv datetime decimal difflib email.message enum functools html.parser http.client inspect io ipaddress itertools json logging math multiprocessing operator os pathlib pickle queue random re socket sqlite3 ssl statistics string struct subprocess tarfile textwrap threading traceback types typing unittest urllib.request uuid xml.etree.ElementTree zipfile".split()
KINDS = [*SECRETS, "random"]
_TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_LENGTH},}}")
#: Characters of tokens get the cells 1 to 67; 0 is everything else and the edge of a word.
_ALPHABET = string.ascii_letters + string.digits + "+/_=-"
_CELL = np.zeros(256, np.int64)
_CELL[list(_ALPHABET.encode())] = np.arange(1, len(_ALPHABET) + 1)
CELLS = len(_ALPHABET) + 1
_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


ALPHABETS = ("0123456789abcdef", string.ascii_uppercase + "234567", string.ascii_lowercase + string.digits, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_")


def random_strings(n: int = TRAIN_STRINGS, seed: int = 11) -> list[tuple[int, str]]:
    """The labelled sample: (alphabet, string) of 16 to 64 characters over hex, base 32, base 36, base 62 and base 64 digits."""
    rng = random.Random(seed)
    return [(a, "".join(rng.choices(ALPHABETS[a], k=rng.randint(16, 64)))) for a in (rng.randrange(len(ALPHABETS)) for _ in range(n))]


def identifiers(modules: list[str]) -> list[str]:
    """The names that modules, their classes and the variables of their functions have."""
    names: set[str] = set()
    for module in map(importlib.import_module, modules):
        for name in dir(module):
            names.add(name)
            value = getattr(module, name, None)
            if inspect.isclass(value):
                names.update(dir(value))
            elif inspect.isfunction(value):
                names.update(value.__code__.co_varnames)
    return sorted(names)


def numbers(n: int = TRAIN_STRINGS, seed: int = 12) -> list[str]:
    """Labelled as ordinary: numbers of up to 20 digits, dates and times."""
    rng = random.Random(seed)
    two = lambda most: f"{rng.randint(1, most):02}"
    return [str(rng.randrange(10 ** rng.randint(1, 20))) if i % 2 else f"{rng.randint(1990, 2040)}-{two(12)}-{two(28)}T{two(23)}-{two(59)}" for i in range(n)]


def transitions(cells: np.ndarray) -> np.ndarray:
    return np.bincount(cells[:-1] * CELLS + cells[1:], minlength=CELLS * CELLS)


def _of(tokens: list[str]) -> np.ndarray:
    data = "\n" + "\n".join(tokens) + "\n"
    return transitions(_CELL[np.frombuffer(data.encode(), np.uint8)]).astype(float)


def log_model(counts: np.ndarray, prior: np.ndarray | float = 0.5) -> np.ndarray:
    m = counts.reshape(CELLS, CELLS) + prior
    return np.log(m / m.sum(axis=1, keepdims=True))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per partition: transitions inside words and at their edges."""
    total = np.zeros(CELLS * CELLS, np.int64)
    for batch in batches:
        for part in text_slices(batch):
            total += transitions(_CELL[utf8(" " + " ".join(texts(part)) + " ")])
    yield pa.RecordBatch.from_pydict({"counts": pa.array([total.tolist()], pa.list_(pa.int64()))})


@dataclass
class Models:
    """Log probabilities of transitions: (models, CELLS, CELLS) each of random strings and of ordinary tokens."""

    random: np.ndarray
    ordinary: np.ndarray

    def ratio(self, token: str) -> float:
        """Log-likelihood ratio of a token, by the model of either side that suits it best."""
        c = _CELL[np.frombuffer(token.encode(), np.uint8)]
        best = lambda m: m[:, c[:-1], c[1:]].sum(axis=1).max()
        return float(best(self.random) - best(self.ordinary))


def trained(docs: DataFrame) -> Models:
    """The models of the labelled samples and of the corpus."""
    rows = docs.mapInArrow(_count, "counts array<long>").select(F.posexplode("counts")).groupBy("pos").agg(F.sum("col").alias("n")).orderBy("pos").collect()  # CELLS ** 2 rows
    corpus = np.array([r.n for r in rows] or [0] * CELLS * CELLS, float)
    known, sample = log_model(_of(identifiers(NAMED_IN))), random_strings()
    drawn = [log_model(_of([t for k, t in sample if k == a])) for a in range(len(ALPHABETS))]
    return Models(np.stack(drawn), np.stack([known, log_model(_of(numbers()), np.exp(known)), log_model(corpus, PRIOR * np.exp(known))]))


def find(text: str, models: Models) -> tuple[dict[str, list], list]:
    """Base spans by kind, and the spans that the models add."""
    base = {k: f(text) for k, f in SECRETS.items()}
    taken = Taken([s for found in base.values() for s in found])
    more = []
    for m in _TOKEN.finditer(text):
        if not taken.overlaps(*m.span()) and models.ratio(m.group()) >= THRESHOLD:
            more.append((*m.span(), "random"))
    return base, more


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: counts of the base kinds, their digest, and all spans."""
    base = keyed(docs, id_col, text_col)
    models = trained(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                rows = []
                for text in texts(part):
                    found, more = find(text, models)
                    own = [s for spans in found.values() for s in spans]
                    rows.append((*map(len, found.values()), sha256(joined(own, KINDS)), joined(own + more, KINDS)))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], [x.split()[0] for x in _SCHEMA.split(", ")])

    return base.mapInArrow(run, _SCHEMA)
