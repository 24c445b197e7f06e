"""Labelled findings that the secret scan learns from.

Every kind of credential and of look-alike below has ROWS findings, made from
its form by a fixed seed (none is a real credential), in the contexts such
strings are found in.  Label 1 is a secret, 0 a reviewed look-alike.
"""

from __future__ import annotations

import base64
import random
import uuid

ROWS = 120
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALNUM, HEX = LOWER + UPPER + DIGITS, DIGITS + "abcdef"
#: Words of identifiers, paths and prose (fixed values); they join the corpus' vocabulary.
WORDS = ("account", "adapter", "average", "background", "between", "buffer", "button", "cache", "callback", "client", "column", "common",
         "config", "connection", "container", "content", "context", "control", "country", "current", "database", "default", "deploy",
         "description", "different", "document", "element", "engine", "error", "example", "factory", "feature", "filter", "format",
         "function", "general", "handler", "header", "history", "important", "index", "information", "interface", "internal", "language",
         "library", "manager", "market", "message", "method", "module", "monitor", "national", "network", "number", "object", "option",
         "package", "parameter", "parser", "people", "picture", "policy", "position", "process", "product", "production", "project",
         "provider", "question", "record", "release", "request", "resource", "response", "result", "schedule", "script", "section",
         "server", "service", "session", "simple", "source", "standard", "status", "storage", "string", "structure", "student", "system",
         "table", "template", "thread", "update", "upload", "version", "wrapper", "writer")
_PROSE = ("see ", "the file ", "and then ", "as of ", "w12 w7 ", "about 12 ", "He said ", "", "\n", "of it. ", "id ", "(")
_AFTER = (" ", "", "\n", ", and", " w3 w18 ", ".", ") ")


def _rng_text(rng: random.Random, letters: str, n: int) -> str:
    return "".join(rng.choice(letters) for _ in range(n))


def _assigned(rng: random.Random, name: str) -> tuple[str, str]:
    """Text before and after a value that is given to ``name``."""
    name = rng.choice((name, name.upper(), name.replace("_", "-"), f"my_{name}", f"  {name}", f"export {name.upper()}", f'"{name}"', f"w5 {name}"))
    quote = rng.choice(("", '"', '"', "'"))
    return name + rng.choice(("=", " = ", ": ", ":")) + quote, quote + rng.choice(_AFTER)


def _password(rng: random.Random) -> str:
    """Eight characters or more of several classes, often a bent word with signs."""
    if rng.random() < 0.6:
        word = rng.choice(WORDS)[:rng.randrange(4, 9)]
        bent = "".join({"a": "4", "e": "3", "o": "0", "i": "1", "s": "5"}.get(c, c) if rng.random() < 0.6 else c for c in word)
        return bent.capitalize() + _rng_text(rng, "!&%$#@*-_+?", rng.randrange(1, 3)) + _rng_text(rng, ALNUM, rng.randrange(2, 6)) + rng.choice(DIGITS)
    return _rng_text(rng, ALNUM + "!&%$#@*-_+?.", rng.randrange(9, 25)) + rng.choice(DIGITS)


def _words(rng: random.Random, n: int, joint: str, form=str) -> str:
    return joint.join(form(rng.choice(WORDS)) for _ in range(n))


def findings() -> list[tuple[str, str, str, float]]:
    """(candidate, before, after, label)."""
    rng = random.Random(11)
    text, out = lambda letters, n: _rng_text(rng, letters, n), []
    b64 = lambda n: base64.b64encode(rng.randbytes(n)).decode().rstrip("=")
    key_names = ("api_key", "apikey", "secret", "client_secret", "token", "access_token", "auth_token", "secret_key", "credential", "private_key")
    anywhere = (        # credentials that their own form gives away
        lambda: "AKIA" + text(UPPER + "234567", 16), lambda: "ASIA" + text(UPPER + "234567", 16), lambda: f"gh{rng.choice('pousr')}_" + text(ALNUM, 36),
        lambda: "github_pat_" + text(ALNUM, 22) + "_" + text(ALNUM, 59), lambda: "glpat-" + text(ALNUM + "_-", 20),
        lambda: f"xox{rng.choice('abprs')}-" + text(DIGITS, 12) + "-" + text(ALNUM, 24), lambda: "AIza" + text(ALNUM + "_-", 35),
        lambda: rng.choice(("sk_live_", "rk_live_", "sk_test_")) + text(ALNUM, 24), lambda: "sk-" + text(ALNUM, 48), lambda: "npm_" + text(ALNUM, 36),
        lambda: "SK" + text(HEX, 32), lambda: "eyJ" + b64(rng.randrange(24, 90)), lambda: "hf_" + text(LOWER + UPPER, 34), lambda: text(ALNUM, 40))
    given = (           # credentials that are given to a name
        (lambda: text(ALNUM + "+/", 40), ("aws_secret_access_key", "secret", "secret_key")), (lambda: text(HEX, rng.choice((32, 40, 64))), key_names),
        (lambda: text(ALNUM, rng.randrange(20, 50)), key_names), (lambda: text(ALNUM + "_-", rng.randrange(16, 44)), key_names),
        (lambda: b64(rng.randrange(16, 64)), key_names), (lambda: str(uuid.UUID(int=rng.getrandbits(128))), ("api_key", "client_secret", "token")),
        (lambda: _password(rng), ("password", "passwd", "pwd", "db_password")), (lambda: _password(rng), ("password", "passwd", "pwd", "secret")),
        (lambda: text(HEX, rng.randrange(12, 33)), ("password", "passwd", "pwd")), (lambda: text(ALNUM, rng.randrange(10, 24)), ("password", "pwd", "token")))
    for make in anywhere:
        for _ in range(ROWS):
            before, after = _assigned(rng, rng.choice(key_names)) if rng.random() < 0.4 else (rng.choice(_PROSE), rng.choice(_AFTER))
            out.append((make(), before, after, 1.0))
    for make, names in given:
        for _ in range(ROWS):
            out.append((make(), *_assigned(rng, rng.choice(names)), 1.0))
    for _ in range(2 * ROWS):       # lines of private keys: whole lines of base64 below a header or another line
        line = b64(48)
        out.append((line, rng.choice(("-----BEGIN RSA PRIVATE KEY-----\n", "-----BEGIN PRIVATE KEY-----\n", f"{b64(48)[-40:]}\n")), f"\n{b64(12)}", 1.0))

    plain = (           # look-alikes in prose, code and addresses
        (lambda: _words(rng, rng.randrange(2, 6), "_"), _PROSE), (lambda: _words(rng, rng.randrange(2, 6), "-"), _PROSE),
        (lambda: _words(rng, rng.randrange(2, 5), "", str.capitalize), _PROSE), (lambda: _words(rng, rng.randrange(2, 6), ""), _PROSE),
        (lambda: _words(rng, rng.randrange(2, 5), "_", str.upper), _PROSE), (lambda: _words(rng, rng.randrange(3, 7), "/"), ("/", "./", "see ", "http://a.b/", "/usr/")),
        (lambda: _words(rng, 3, "-") + f"-{rng.randrange(1000)}", ("http://x.org/", "https://www.example.com/", "/")),
        (lambda: _words(rng, 2, "-"), ("jane@", "x.y@", "http://www.", ".")), (lambda: _words(rng, 2, "_") + str(rng.randrange(99)), _PROSE),
        (lambda: text(HEX, 40), ("commit ", "revision ", "index ", "git show ", "@", "tree ")), (lambda: text(HEX, rng.choice((32, 64))), ("sha256:", "md5 ", "checksum ", "sha256 ", "etag ")),
        (lambda: "sha512-" + text(ALNUM + "+/", 86), ('integrity="', '"integrity": "')), (lambda: str(uuid.UUID(int=rng.getrandbits(128))), _PROSE + ("id=", 'id: "', "uuid ")),
        (lambda: text(DIGITS, rng.randrange(16, 24)), _PROSE), (lambda: f"20{rng.randrange(10, 30)}-0{rng.randrange(1, 9)}-1{rng.randrange(9)}T{rng.randrange(10, 24)}-{rng.randrange(10, 60)}-00", _PROSE),
        (lambda: rng.choice("-_+/") * rng.randrange(16, 70), _PROSE), (lambda: b64(rng.randrange(60, 300)), ("data:image/png;base64,", "url(data:font/woff;base64,")),
        (lambda: text(rng.choice(("ACGT", "xo", "01")), rng.randrange(16, 60)), _PROSE), (lambda: _words(rng, 3, "+"), ("q=", "search?q=")))
    for make, befores in plain:
        for _ in range(ROWS):
            out.append((make(), rng.choice(befores), rng.choice(_AFTER), 0.0))
    named = (           # what stands beside a cue and is no secret
        lambda: "your_" + _words(rng, 1, "") + rng.choice(("_here", "_key")), lambda: "${" + _words(rng, 2, "_", str.upper) + "}", lambda: _words(rng, 2, "_"),
        lambda: f"process.env.{_words(rng, 2, '_', str.upper)}", lambda: f"get_{_words(rng, 1, '')}()", lambda: "x" * rng.randrange(8, 20), lambda: "*" * rng.randrange(8, 20),
        lambda: f"self.{_words(rng, 2, '_')}", lambda: _words(rng, 2, "", str.capitalize), lambda: rng.choice(WORDS) + rng.choice(("ing", "ation", "able")),
        lambda: f"<{_words(rng, 2, '-')}>", lambda: f"{{{{ {rng.choice(WORDS)} }}}}".replace(" ", ""), lambda: _words(rng, 3, "-"))
    for make in named:
        for _ in range(ROWS):
            out.append((make(), *_assigned(rng, rng.choice(key_names + ("password", "passwd", "pwd"))), 0.0))
    return out
