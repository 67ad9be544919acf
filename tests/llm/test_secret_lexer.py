"""The lexer of the secret scan: what it reads, what it leaves alone, and time in proportion to the text."""

import time

import pytest

from hinode.llm import secrets

FOUND = {
    'db_password = """s3cr3tValue99"""': ["s3cr3tValue99"],
    "db_password = '''s3cr3t\nValue99'''": ["s3cr3t\nValue99"],
    'privateKey = "q8Zk2Lm9Xw"': ["q8Zk2Lm9Xw"],
    "const accessKey = `q8Zk2Lm9Xw`;": ["q8Zk2Lm9Xw"],
    '<password>hunter2Zq81x</password>': ["hunter2Zq81x"],
    '<cfg:apiKey a="b"> q8Zk2Lm9Xw </cfg:apiKey>': ["q8Zk2Lm9Xw"],
    'client_secret: |\n  q8Zk2Lm9Xw77\n  Lm9Xq8Zk2w55\nother: 1\n': ["q8Zk2Lm9Xw77", "Lm9Xq8Zk2w55"],
    '  - passwd: >-\n      q8Zk2Lm9Xw77\n    next: x\n': ["q8Zk2Lm9Xw77"],
    r'password = "ab\"c9Zk2Lm"': [r'ab\"c9Zk2Lm'],
    'password: str = "q8Zk2Lm9Xw"': ["q8Zk2Lm9Xw"],
    'A = "q8Zk2"\nB = A + "Lm9Xw"\nmy_token = B\n': ["Lm9Xw", "q8Zk2"],
    "--api-key=q8Zk2Lm9Xw77": ["q8Zk2Lm9Xw77"],
    "auth: q8Zk2Lm9Xw77aBcD": ["q8Zk2Lm9Xw77aBcD"],
    "dbpassword = 'q8Zk2Lm9Xw'": ["q8Zk2Lm9Xw"],
    "x.tokens = {'authTokens': 'q8Zk2Lm9Xw'}": ["q8Zk2Lm9Xw"],
    "AWSSecretKey => 'q8Zk2Lm9Xw'": ["q8Zk2Lm9Xw"],
}
CLEAN = [
    'author: "Jane Q. Doe 1985"', 'tokenizer = "bert-base-uncased-v2"', 'secretary: "Maria Lopez 2nd"', 'password = "changeme"',
    "password = '<enter it here>'", 'secret: "We went to the market in 1985 and bought six things"', "authority = 'q8Zk2Lm9Xw77'",
    "passport: 'q8Zk2Lm9Xw77'", "compass = 'north12345x'", "token == 'q8Zk2Lm9Xw77'", "max_tokens = 4096", "note: the token was lost",
    "<p>password</p>", "# password", "monkey = 'q8Zk2Lm9Xw77'", "apiKeyName", "",
]


@pytest.mark.parametrize("text", FOUND)
def test_literals_of_sensitive_names(text):
    data = text.encode()
    assert sorted(data[a:b].decode() for a, b in secrets.literal_spans(data)) == sorted(FOUND[text])
    assert {(a, b) for a, b, k in secrets.find_spans(data) if k == 3} == secrets.literal_spans(data)


@pytest.mark.parametrize("text", CLEAN)
def test_other_literals_are_left_alone(text):
    assert secrets.literal_spans(text.encode()) == set()


def test_words_of_names():
    assert secrets.name_words(b"X-Api-Key") == ["x", "api", "key"] and secrets.name_words(b"dbAuthTokens2") == ["db", "auth", "token", "2"]
    assert secrets.name_score(b"AWSSecretKey") == 3.0 and secrets.name_score(b"tokenizer") == secrets.name_score(b"author") == 0.0


MB = 1_000_000
LONG = {
    "letters and digits": "auth: " + "aB3x" * (MB // 4),
    "base64 lines": "auth: x\n" + ("QmFzZTY0" * 9 + "\n") * (MB // 73),
    "dashes": "token-" * (MB // 6),
    "doubling": "K0 = 'q8Zk2Lm9Xw'\n" + "".join(f"K{i + 1} = K{i} + K{i}\n" for i in range(40_000)) + "password = K40000\n",
    "chain": "K0 = 'q8Zk2Lm9Xw'\n" + "".join(f"K{i + 1} = K{i} + 'x{i}'\nsecret{i} = K{i}\n" for i in range(4_000)),
    "open quotes": 'password = "' * (MB // 12),
    "open triples": "token = '''x \"\"\" " * (MB // 16),
    "open back quotes": "token = ` " * (MB // 10),
    "open elements": "<password>" * (MB // 10),
    "angles": "</" + "<password " * (MB // 10),
    "colons": "secret:" * (MB // 7),
    "spaces": "secret" + " " * MB + "= 'q8Zk2Lm9Xw'",
    "pluses": "secret = " + "a + " * (MB // 4),
    "signs": "secret = a" + "+" * MB,
    "escapes": 'secret = "' + "\\" * MB,
    "blocks": "secret: |\n" + "  q8Zk2Lm9Xw77\n" * (MB // 15),
}


@pytest.mark.parametrize("name", LONG)
def test_a_megabyte_takes_seconds(name):
    data = LONG[name].encode()
    began = time.process_time()
    spans = secrets.find_spans(data)
    assert time.process_time() - began < 8, name
    if name in ("doubling", "spaces", "blocks"):
        assert any(k == 3 for *_, k in spans)
