"""Page differencing from end to end against a brute-force pairing, at several partition counts, with edge cases."""

import random

import pytest

html_text = pytest.importorskip("fieldsift.llm.html_text")


def lcs(a, b):
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            size[i + 1][j + 1] = size[i][j] + 1 if x == y else max(size[i][j + 1], size[i + 1][j])
    return size[-1][-1]


@pytest.mark.parametrize("seed", range(200))
def test_alignment_is_a_longest_common_subsequence(seed):
    rng = random.Random(seed)
    a, b = ([rng.choice("abcdef") for _ in range(rng.randint(0, 30))] for _ in range(2))
    kept = sorted(html_text.shared_lines(a, b))
    assert len(kept) == lcs(a, b)
    at = iter(b)
    assert all(a[k] in at for k in kept)


def test_long_pages_align_in_bounded_memory():
    a = [f"line {k % 9000}" for k in range(20_000)]
    b = [f"line {k * 7 % 9000}" for k in range(20_000)]
    assert html_text.shared_lines(a, b)


def brute(pages):
    """Text by page: pages sorted in memory, copies passed over, differenced with the neighbour of longer agreement."""
    rows = []
    for page_id, url, html in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = rest.split("/")[0].split("?")[0].split("#")[0]
        rows.append((host.lower(), rest[len(host) :].split("?")[0].split("#")[0], page_id, html_text.page_lines(html or "")))
    rows.sort(key=lambda r: r[:3])
    out = {}
    for k, (host, path, page_id, lines) in enumerate(rows):
        near = []
        for step in (-1, 1):
            j = k + step
            while 0 <= j < len(rows) and rows[j][0] == host and rows[j][3] == lines:
                j += step
            if 0 <= j < len(rows) and rows[j][0] == host:
                n = 0
                while n < min(len(path), len(rows[j][1])) and path[n] == rows[j][1][n]:
                    n += 1
                near.append((n, -step, rows[j][3]))
        other = max(near)[2] if near else None
        gone = html_text.shared_lines([x for x, _ in lines], [x for x, _ in other]) if other else set()
        out[page_id] = " ".join(x for i, (x, inside) in enumerate(lines) if inside or i not in gone)
    return out


@pytest.mark.parametrize("parts", [1, 3, 13])
def test_text_equals_brute_force_at_any_partition_count(spark, parts):
    rng = random.Random(7)
    pages = []
    for k in range(160):
        host = rng.choice(["a.org", "a.org", "a.org", "b.org", "C.org"])
        story = [f"story {rng.randint(0, 12)}" for _ in range(rng.randint(0, 4))]
        lines = ["logo", f"menu of {host}", *story, rng.choice(["imprint", "contact"])]
        body = "".join(f"<div>{x}</div>" for x in lines)
        if rng.random() < 0.3:
            body += f"<article><p>logo</p><p>article {rng.randint(0, 3)}</p></article>"
        pages.append((k, f"http://{host}/{rng.choice('xyz')}/{rng.randint(0, 5)}?q={k}", body))
    pages += [(200 + k, "http://a.org/x/3", "<div>logo</div><div>copy</div>") for k in range(40)]  # copies that fill whole ranges
    pages += [(300, None, "<p>no url</p>"), (301, "http://d.org/", None), (302, "mailto:x", ""), (303, "http://d.org/x", "<p>a " + "long &amp; " * 20_000)]
    table = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, host long").repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = html_text.extract_text(table).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(pages)
    assert {r.page_id: r.text for r in got} == brute(pages)
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract_text(table.limit(0)).collect() == []


def test_article_lines_stay_and_other_shared_lines_go(spark):
    page = lambda story: f"<div>logo</div><div>plain {story}</div><main><p>licence</p><p>{story}</p></main><div class='sidebar'>more</div>"
    table = spark.createDataFrame([(k, f"http://a.org/{k}", page(s)) for k, s in enumerate(["one", "two"])], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract_text(table).collect()}
    assert got == {0: "plain one licence one", 1: "plain two licence two"}
