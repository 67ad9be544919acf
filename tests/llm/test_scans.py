"""License and page scans: the ranking by compression against every template, and time in proportion to the text."""

import random
import time

import pytest

from hinode.llm import html, licenses

MB = 1_000_000


def licensed_texts():
    rng = random.Random(8)
    words = "the a of system data value and file license software version under released copyright terms work".split()
    texts = ["Released under the MIT terms.", "Released under the MIT License."]
    for name, template in licenses.TEMPLATES.items():
        for _ in range(8):
            own = template.split()
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                k = rng.randrange(len(own))
                own[k : k + rng.choice([0, 1])] = [rng.choice(words)]
            fill = lambda n: " ".join(rng.choice(words) for _ in range(n))
            texts.append(f"{fill(rng.choice([0, 30, 400]))}\n{' '.join(own)}\n{fill(rng.choice([0, 50]))}")
        other = rng.choice(list(licenses.TEMPLATES.values()))
        texts.append(f"{template} {other} {template}")
    return texts


def test_ranking_finds_what_all_templates_find():
    """Every template is aligned with the whole of each text; what the ranking confirms must be the same."""
    known = licenses.Templates(licenses.TEMPLATES)
    same = total = 0
    for text in licensed_texts():
        regions = licenses.candidate_regions(text, known.reach, known.telling)
        got = [(start + a, start + b, n) for start, end in regions for a, b, n, *_ in known.confirm(text[start:end])]
        every = [(a, b, n) for a, b, n, *_ in known.confirm(text, sorted(known.words))]
        total += len(every)
        same += len(set(got) & set(every))
        assert set(got) <= set(every) or len(got) >= len(every)
    assert total > 60 and same / total >= 0.98


def test_a_changed_word_of_a_short_notice(spark):
    rows = [(1, "Released under the MIT terms."), (2, "released by the mit terms"), (3, None), (4, "")]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.license, r.missing, r.exact) for r in got] == [(1, "MIT", ["license"], False)]


LICENSED = {
    "notices": "Released under the MIT License. " * 4000,
    "long notices": (licenses.TEMPLATES["MIT-notice"] + " and ") * 400,
    "telling words": "software license " * 8000,
    "one word": "license" * 30_000,
    "dots": "a." * 100_000 + " license",
}


@pytest.mark.parametrize("name", LICENSED)
def test_many_notices_take_seconds(name):
    known = licenses.Templates(licenses.TEMPLATES)
    began, text, found = time.process_time(), LICENSED[name], []
    for start, end in licenses.candidate_regions(text, known.reach, known.telling):
        found += known.confirm(text[start:end])
    assert time.process_time() - began < 20, name
    assert len(found) == {"notices": 4000, "long notices": 400}.get(name, 0)


PAGES = {
    "open tags": "<a " * (MB // 3),
    "open tags, one end": "<a " * (MB // 3) + ">",
    "open quotes": '<a "' * (MB // 4),
    "ends in quotes": '<a ">" ' * (MB // 7) + "'",
    "mixed quotes": "<a '\"> " * (MB // 8),
    "declarations": "<!" * (MB // 2),
    "data": "<![CDATA[" * (MB // 9),
    "comments": "<!--" * (MB // 4),
    "scripts": "<script>" * (MB // 8),
    "deep": "<div>x" * (MB // 6),
    "deep and closed": "<div>" * (MB // 12) + "</b>" * (MB // 12),
    "inline across blocks": "<b><div>" * (MB // 30) + "</b>" * (MB // 30),
    "signs": "<" * MB,
    "spaces": "<a" + " " * MB,
}


@pytest.mark.parametrize("name", PAGES)
def test_a_malformed_megabyte_takes_seconds(name):
    began = time.process_time()
    html.page_blocks(PAGES[name])
    assert time.process_time() - began < 20, name


def test_tokens_are_what_a_backtracking_pattern_finds():
    import re

    pattern = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
    rng = random.Random(5)
    pieces = ["<a", "</b", ">", "'", '"', " x=", "<!--", "-->", "<![CDATA[", "]]>", "<!", "<?", "t", "<", "/", " ", "<p>", "</p>"]
    for _ in range(4000):
        page = "".join(rng.choice(pieces) for _ in range(rng.randrange(25)))
        tokens, at, got = html.Tokens(page), 0, []
        while token := tokens.after(at):
            got.append(token[:2])
            at = token[1]
        assert got == [m.span() for m in pattern.finditer(page)], page
