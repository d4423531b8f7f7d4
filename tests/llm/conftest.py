import random
import re

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, key string, doc string, size int"
SEPARATED = re.compile(r"[^\x20\x09-\x0D]+")


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('bcdfgklmnprst')}{rng.randrange(90)}" for _ in range(n))


def rows_of(texts, lang="xx", source="web"):
    """Rows with ids from 1 on and extra columns whose names the operators use themselves."""
    return [(i + 1, t, lang, source, len(t or ""), -i, "k", "d", 7) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def hard_texts():
    """Null, empty, blank, short, very long and periodic texts, exact and near copies, shared passages, ties."""
    rng = random.Random(3)
    passage = sentence(rng, 60)
    long = sentence(rng, 6000)
    base = sentence(rng, 120).split(" ")
    near = base[:60] + ["other"] + base[61:]
    out = [None, "", " \t\n ", "one", "two words", "ONE", long, "ab" * 900, "été   naïve \U0001f600 " * 40]
    out += [sentence(rng, rng.randrange(5, 150)) for _ in range(20)]
    out += [sentence(rng, 30) + " " + passage + " " + sentence(rng, 30), passage + "\n" + sentence(rng, 50), passage.upper()]
    out += [" ".join(base), " ".join(near), " ".join(base).upper(), *[sentence(random.Random(9), 80)] * 12]
    out += ["line of a text\nline of a text\n\nanother line\nline of a text", "same word " * 60, long[:3000]]
    return out


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def hard(make, hard_texts):
    """The hard texts, with a row that occurs twice, a null id, and null languages and sources."""
    rows = rows_of(hard_texts)
    rows.append(rows[12])
    rows.append((None, "text of a row without an id " * 12, None, None, None, None, None, None, None))
    return make(rows)
