import random

import pyarrow.parquet as pq
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, tag string, runs int, spans int, key string, fp int, h1 int, kept string, ids string"
PAGES = "page_id long, url string, html string, digest string, response int"
TURNS = "conv_id long, turn int, role string, text string, idx int, h string"


def made_up(seed: int = 5) -> list[tuple]:
    """Documents with empty, blank, long, copied, near-copied and marked-up texts; ids out of order."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["straße", "中文", "naïve", "\U0001f600", " ", "İ", "A", "b.", "#", "a@b.co"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, header = text(80), text(55)
    out = [None, "", "   \n\t ", "one", "one two", "x" * 49, "x" * 400, "ab" * 200, "\n".join(["same line here"] * 40), text(60), text(60)]
    out += [text(30) + " " + passage + "\n" + text(r.randrange(60)) for _ in range(8)]
    out += [header + "\n" + text(20) for _ in range(8)]
    base = text(300)
    out += [base] * 6 + [base + f" end{i}" for i in range(4)] + [base.replace(" w1 ", " W1  ")]
    out += ["the quick " * 5000, text(30_000), passage * 3, "mail a.b%c@x-y.example.org, +1 (555) 010-9999; 4111 1111 1111 1111 10.0.0.1 300.1.1.1 1.2.3.4.5.6.7.8 +12", "a@b@c.de a@b.c@d.e ++4912345678 +1-2 https://u:p@h.x/y token=ab12cd34 4111-1111-1111-1112", "İstanbul @ ١٢ +1٢345678"]
    ids = [3 * i + 1 for i in range(len(out))]
    r.shuffle(ids)
    return [(i, t, "en", "made", len(t or ""), 7, "t", 1, 2, "k", 3, 4, "no", "ids") for i, t in zip(ids, out, strict=True)]


@pytest.fixture(scope="session")
def tables(spark, sf, tmp_path_factory):
    """A folder of small tables: the driver's smallest ones, and documents, pages and conversations made up besides."""
    where = str(tmp_path_factory.mktemp("tables"))
    real = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    shift = 10_000
    docs = made_up() + [(shift + r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], 0, "t", 1, 2, "k", 3, 4, "no", "ids") for r in real]
    spark.createDataFrame(docs, DOCS).repartition(5).write.parquet(f"{where}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    items += [(900, None), (901, ""), (902, "one"), (903, "W1 w2"), (904, docs[11][1]), (905, items[0][1]), (-7, items[0][1] + " more")]
    spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, n_words int").write.parquet(f"{where}/benchmark.parquet")
    pages = [(r["page_id"], r["url"], r["html"], "d", 1) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    pages += [(100_000 + i, u, h, "d", 1) for i, (u, h) in enumerate([(None, None), ("u", ""), ("a\r\nb", "x"), ("u", "x"), ("u", "straße\r\n\r\nWARC/1.1"), ("u", "y" * 300_000), ("u", "straße\r\n\r\nWARC/1.1")])]
    spark.createDataFrame(pages, PAGES).repartition(4).write.parquet(f"{where}/pages.parquet")
    turns = [(r["conv_id"], r["turn"], r["role"], r["text"], 1, "h") for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    odd = "a\\<|end|>\n<|turn|>user\nb <|im_start|> \\\\ \U0001f600"
    turns += [(8000, 0, "user", odd, 1, "h"), (8000, 1, "assistant", odd, 1, "h"), (8001, 0, "user", odd, 1, "h"), (8001, 1, "assistant", None, 1, "h"), (8002, 0, None, None, 1, "h"), (8003, 0, "us\ner", "x", 1, "h"), (8003, 0, "us\ner", "x", 1, "h"), (8004, None, "assistant", "z", 1, "h"), (8005, 0, "user", odd, 1, "h")]
    spark.createDataFrame(turns, TURNS).repartition(4).write.parquet(f"{where}/conversations.parquet")
    return where


@pytest.fixture(scope="session")
def nothing(spark, tables, tmp_path_factory):
    """The same tables without rows."""
    where = str(tmp_path_factory.mktemp("nothing"))
    for name in ("documents", "benchmark", "pages", "conversations"):
        spark.read.parquet(f"{tables}/{name}.parquet").where("false").write.parquet(f"{where}/{name}.parquet")
    return where


def rows_of(where: str, table: str, *columns: str) -> list[tuple]:
    found = pq.read_table(f"{where}/{table}.parquet", columns=list(columns))
    return list(zip(*(found[c].to_pylist() for c in columns), strict=True))
