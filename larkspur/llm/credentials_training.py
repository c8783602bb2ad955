"""Labelled lines, made from a seed, and the training of the conditional random field on them.

``python -m larkspur.llm.credentials_training`` writes ``credentials_model.json``. The lines follow common practice of programming and
configuration languages. Connection strings, command options, elements, netrc lines and trailing comments are kept out of
training: `unseen` makes such lines, on which the tests measure what the field does with forms it was not trained on.
"""

from __future__ import annotations

import base64
import json
import math
import random
import string

from larkspur.llm.credentials import LINKS, MODEL, PREFIXES, SENSES, SHAPES, SIZES, Field_, Token, described, features, tokens

#: Lines made for training (the bound of the fit).
LINES = 12000
_WORDS = (
    "apple river stone cloud tiger maple ocean desert violin candle harbor winter copper lantern meadow falcon ginger marble orchid pepper rocket saddle tunnel walnut zephyr"
    " basket cactus dragon ember forest garden hammer island jungle kitten ladder magnet nectar oyster pillow quartz ribbon silver temple umbrella velvet window yellow"
).split()
_SERVICES = "billing mailer search payments orders reports archive gateway scheduler inventory".split()
_SECRET_NAMES = (
    "password passwd pwd passphrase db_password db_pass smtp_pwd admin_password root_password api_key apikey auth_key access_key secret_key encryption_key signing_key token auth_token"
    " access_token refresh_token bearer_token api_token secret client_secret app_secret webhook_secret credential service_credentials ssh_key private_key"
).split()
_OTHER_NAMES = "etag checksum sha256 image_digest md5sum key_id token_id commit revision request_uuid public_key fingerprint content_hash password_hash".split()
_NEUTRAL_NAMES = "name title label host bucket region color path table column version template message url endpoint payload icon font data image build session_label description".split()


def _random(r: random.Random, n: int, chars: str = string.ascii_letters + string.digits) -> str:
    return "".join(r.choice(chars) for _ in range(n))


def _hex(r: random.Random, n: int) -> str:
    return _random(r, n, "0123456789abcdef")


def _password(r: random.Random) -> str:
    a, b = r.choice(_WORDS), r.choice(_WORDS)
    return r.choice([
        a.capitalize() + r.choice("!#%*_-@$^&+=") + b.capitalize() + str(r.randint(1, 9999)), a + str(r.randint(10, 99999)), a.capitalize() + str(r.randint(10, 9999)) + r.choice("!?$%*"),
        _random(r, r.randint(8, 16), string.ascii_letters + string.digits + "!%*#_-$^&"), a[:3].upper() + _random(r, r.randint(4, 8)), a + r.choice("-_.") + b + r.choice("-_.") + str(r.randint(1, 999)),
    ])


def _key(r: random.Random) -> str:
    return r.choice([
        _random(r, r.randint(20, 48)), _random(r, r.randint(24, 56), string.ascii_letters + string.digits + "+/") + r.choice(["", "=", "=="]), _random(r, r.randint(24, 44), string.ascii_letters + string.digits + "-_"),
        _hex(r, r.choice([24, 32, 40, 48, 64])), "-".join(_hex(r, k) for k in (8, 4, 4, 4, 12)), r.choice(_WORDS)[:3] + "-" + _random(r, 26), r.choice(_WORDS)[:3] + "." + _random(r, 28), _known(r),
    ])


def _known(r: random.Random) -> str:
    """A key of a well-known format."""
    p = r.choice(PREFIXES)
    if p == "eyJ":
        return "eyJ" + _random(r, 30) + "." + _random(r, 40) + "." + _random(r, 43)
    if p in ("AKIA", "ASIA"):
        return p + _random(r, 16, string.ascii_uppercase + string.digits)
    return r.choice([p + _random(r, r.randint(20, 40)), r.choice(_WORDS)[:3] + r.choice(["_live_", "_test_", "_prod_"]) + _random(r, 24)])


def _secret(r: random.Random) -> str:
    return _password(r) if r.random() < 0.5 else _key(r)


def _phrase(r: random.Random) -> str:
    return " ".join(r.choice(_WORDS) for _ in range(r.randint(3, 6)))


def _stand_in(r: random.Random) -> str:
    """What stands where a credential would, or says where it is kept."""
    w, v = r.choice(_WORDS), r.choice(_SERVICES)
    return r.choice([
        f"your-{w}-key", f"<your-{w}-key>", f"<{v}_token>", f"{{{{ {v}_key }}}}", f"PUT_{v.upper()}_KEY_HERE", f"YOUR_{v.upper()}_TOKEN", "changeme", "change-me", "TODO", "not-set", "...", "xxxxxx", "********", "<redacted>", "[REDACTED]", f"vault:{v}/kind",
        f"env:{v.upper()}_KEY", f"file:/run/secrets/{w}", "${SMTP_PWD}", f"${{{v.upper()}_KEY}}", f"$({v}_key)", f"%({v})s", f"example-{w}", f"dummy_{w}", f"insert-{w}-secret-here", "", "none", "null", "placeholder", "sample-token", "password", "secret", "token",
        f"{w}-name", w, f"{w}_{v}", f"{v}.{w}", f"{w}.example", f"{v}-{w}-ref", str(r.randint(1, 9999)), f"{v.upper()}_TOKEN", f"/etc/{v}/keys", f"./{v}.pem", f"{w.capitalize()}{v.capitalize()}", f"{v}/{w}", "X-Api-Key", "Authorization", "access_token", "string", "true",
    ])


def _sentence(r: random.Random) -> str:
    w, v = r.choice(_WORDS), r.choice(_SERVICES)
    return r.choice([
        "Enter your password", f"The {v} token has expired", f"Password for {v}", f"no key for the {w}", f"token is missing", f"The secret must not be empty.", f"Invalid {v} credentials", f"Reset the password of {{user}}", f"wrong password for %s", f"{v} key not found: {{}}",
        f"please rotate the {w} key", f"Show password", f"Copy token", f"API key", "New password", f"{v} secret, {w} secret",
    ])


def _value(r: random.Random) -> str:
    """A value that is no credential whatever it looks like, under a name that says nothing of credentials."""
    return r.choice([
        r.choice(_WORDS), _hex(r, r.choice([7, 12, 32, 40, 64])), _random(r, r.randint(6, 40)), _random(r, 60, string.ascii_letters + string.digits + "+/"), "-".join(_hex(r, k) for k in (8, 4, 4, 4, 12)), str(r.randint(0, 10**6)), f"{r.choice(_WORDS)}{r.randint(1, 99)}",
        f"v{r.randint(1, 9)}.{r.randint(0, 30)}.{r.randint(0, 9)}", f"{r.choice(_SERVICES)}.example.com", f"/srv/{r.choice(_WORDS)}/{r.randint(1, 9)}", r.choice(_WORDS)[:3] + "-" + _random(r, 14), _password(r), _sentence(r), _phrase(r), f"sha512-{_random(r, 60)}",
        f"{r.choice(_WORDS).upper()}_{r.choice(_SERVICES).upper()}", "", "a, b, c", f"{r.choice(_WORDS)} {r.choice(_WORDS)}", f"%s {r.choice(_WORDS)}", "#" + _hex(r, 6), "<b>x</b>", "https://" + r.choice(_SERVICES) + ".example/" + _hex(r, 8),
    ])


def _name(r: random.Random, names: list[str]) -> str:
    parts = r.choice(names).split("_")
    parts = r.choice([parts, parts, [r.choice(_SERVICES), *parts], [*parts, str(r.randint(1, 9))]])
    return r.choice(["_".join(parts), "_".join(parts).upper(), parts[0] + "".join(p.capitalize() for p in parts[1:]), "-".join(parts), ".".join(parts)])


def _mark(s: str) -> str:
    return f"\x02{s}\x03"


def _assigned(r: random.Random, n: str, value: str) -> str:
    """A name and its value in code or configuration."""
    word = n.replace("-", "_").replace(".", "_")
    q = r.choice("\"\"'")
    forms = [
        f"{word} = {q}{value}{q}", f"const {word} = {q}{value}{q};", f'private static final String {word} = "{value}";', f'{word} := "{value}"', f"    {q}{n}{q}: {q}{value}{q},", f"    {word}={q}{value}{q},", f"{n}: {q}{value}{q}", f'conf.set("{n}", "{value}")',
        f'    {word}: str = "{value}"', f'let {word}: string = "{value}";', f'        {word.capitalize()}: "{value}",', f'client = Client(host, {word}="{value}")', f"this.{word} = {q}{value}{q};", f'if {word} == "{value}":', f"self.{word} = {q}{value}{q}",
    ]
    if value and " " not in value and not any(c in value for c in "#{(["):
        forms += [f"{n}={value}", f"export {word}={value}", f"{n}: {value}", f"{n} = {value}", f"  - {n}: {value}"]
    return r.choice(forms)


def line(r: random.Random) -> str:
    """A line with its credentials between \\x02 and \\x03."""
    kind, w, v = r.random(), r.choice(_WORDS), r.choice(_SERVICES)
    if kind < 0.28:
        return _assigned(r, _name(r, _SECRET_NAMES), _mark(_secret(r)))
    if kind < 0.32:
        return _assigned(r, _name(r, _SECRET_NAMES), _mark(_phrase(r)))
    if kind < 0.44:
        return _assigned(r, _name(r, _SECRET_NAMES), _stand_in(r) if r.random() < 0.7 else _sentence(r))
    if kind < 0.49:
        return _assigned(r, _name(r, _OTHER_NAMES), r.choice([_hex(r, 40), _key(r), _random(r, 20), _password(r), str(r.randint(1, 999)), _stand_in(r)]))
    if kind < 0.62:
        return _assigned(r, _name(r, _NEUTRAL_NAMES), r.choice([_value, _value, _value, _phrase, _stand_in, _password])(r))
    if kind < 0.66:
        return _assigned(r, _name(r, _NEUTRAL_NAMES), _mark(_known(r)))
    if kind < 0.73:
        p = _mark(_random(r, r.randint(8, 18), string.ascii_letters + string.digits + "!*-_"))
        return r.choice([
            f'dsn = "postgres://{w}:{p}@{v}.example/{w}"', f"broker: amqp://{w}:{p}@{v}.example:5671/", f'{w} = "mysql://{v}/{w}?sslmode=require"', f'x = "https://{v}.example/hook?token={_mark(_random(r, 32))}&v=1"',
            f'y = "https://{v}.example/list?page=3&order=asc&cursor={_random(r, 20)}"', f'u = "redis://{w}:${{REDIS_PASS}}@{v}/0"', f'u = "redis://{w}:<password>@{v}/0"', f'see = "https://{v}.example/docs/token"', f"conn({_quote(f'mongodb://{w}:{p}@{v}/x')})", f"# mirror at https://{v}.example/{w}?q=1",
        ])
    if kind < 0.8:
        pair = base64.b64encode(f"{w}:{_password(r)}".encode()).decode()
        return r.choice([
            f'h = "Basic {_mark(pair)}"', f'headers = {{"Authorization": "Bearer {_mark(_key(r))}", "retries": 3}}', f'req.setHeader("Authorization", "Bearer {_mark(_key(r))}");', f'{w} = "Basic training for {v}"', f'{w} = "Basic {w}"', 'h = {"Authorization": "Bearer <token>"}',
            f'h = "Bearer {{{v}_token}}"', f'h = "Bearer " + {v}Token', "// Authorization: Bearer " + _mark(_key(r)),
        ])
    if kind < 0.85:
        c, s = r.choice(["#", "//", "--", " *"]), r.choice([_mark(_secret(r)), _mark(_secret(r)), _stand_in(r) or "none"])
        return r.choice([
            f"{c} password: {s}", f"{c} {v} token = {s}", f"{c} api key: {s}", f"{c} secret={s}", f"{c} {w} login: {_mark(_password(r))}", f"{c} rotate the token every {r.randint(2, 90)} days", f"{c} see {v}: it has no key", f"{c} the {v} token is read from {w}_{v}", f"{c} {w}{r.randint(1, 9)} {_hex(r, 8)} {_random(r, 12)}",
            f"{c} keys: {w}, {v}", f"{c} password is kept in the vault", f"{c} since {_hex(r, 40)}", f"{c} {w} {_key(r) if r.random() < 0.3 else _random(r, 24)}",
        ])
    if kind < 0.91:
        s, n = _secret(r), _name(r, _SECRET_NAMES).replace("-", "_").replace(".", "_")
        i = r.randint(2, len(s) - 2)
        return r.choice([f'{n} = "{_mark(s[:i])}" + "{_mark(s[i:])}"', f"const {n} = '{_mark(s[:i])}' + '{_mark(s[i:])}';", f'{n} = ("{_mark(s[:i])}" "{_mark(s[i:])}")', f'{w} = "{w}" + "{v}"', f'{w} = "{_hex(r, 24)}" + "{_random(r, 20)}"', f'{n} = "{w}-" + {v}_id', f'{n} = "" + "{w}"'])
    if kind < 0.94:
        return r.choice([_mark("-----BEGIN RSA PRIVATE KEY-----"), "-----BEGIN PUBLIC KEY-----", "-----BEGIN CERTIFICATE-----", f'"{_mark("-----BEGIN PRIVATE KEY-----")}"', f'cert = "-----BEGIN CERTIFICATE-----"', f'{_mark("-----BEGIN OPENSSH PRIVATE KEY-----")}'])
    n = _name(r, _SECRET_NAMES).replace("-", "_").replace(".", "_")
    return r.choice([
        f"const {w}Token0 = {{", f"{w}_token1 = parse_{w}({w}_rows, 12)", f'{n} = os.environ["{v.upper()}_TOKEN"]', f'{n} = os.getenv("DB_PASS", "")', f'const {w}Key = process.env["API_KEY"];', f'raise KeyError("the {w} has no rows")', f'String {w}Token1 = "{w}=" + {w}Rows + 12;', f"for key, value in {w}.items():",
        f'    {{"id": 3, "{w}": "{_random(r, 9)}"}},', f'logger.info("token of %s has expired", {w})', f'String token = System.getenv("ACCESS_TOKEN");', f"def get_{n}(self, {w}: str) -> str:", f"if not {n} or len({n}) < {r.randint(8, 64)}:", f'{w}.get("{n}")', f'assert "{n}" in {w}', f"return {n} === other.{n}", f'parser.add_argument("--{n}", help="{_sentence(r)}")',
        f"import {{ {n} }} from './{v}';", f'keys = ["{w}", "{v}"]', f"func {w}(key string, token int) error {{", f"tokens = {w}.split(',')", f"sort(key=lambda x: x.{v})", f'case "{n}":', f"login({w}, {n})", f"{w}.authenticate(user, {n})", f'{n} = read("{v}/{w}.txt")', f'type {w}Key = "{w}" | "{v}";', f"{n} = {v}.{w}_{n}", f"{n}: {v}.{w}",
    ])


def _quote(s: str) -> str:
    return f'"{s}"'


def unseen(r: random.Random) -> tuple[str, str]:
    """(form, line) of the forms that are kept out of training; credentials are marked as in `line`."""
    w, v = r.choice(_WORDS), r.choice(_SERVICES)
    p = _password(r).replace("&", "").replace("$", "").replace("=", "").replace("#", "").replace("@", "") + str(r.randint(10, 99))
    k, n = _random(r, 32), _name(r, _SECRET_NAMES)
    word = n.replace("-", "_").replace(".", "_")
    forms = {
        "connection string": [f'dsn = "host={v} user={w} password={_mark(p)} dbname=x"', f'cs = "Server={v};Uid=sa;Pwd={_mark(p)};Database={w}"', f'"Endpoint=sb://{v}.example/;SharedAccessKeyName=root;SharedAccessKey={_mark(k)}"'.replace("sb://", ""), f"String c = \"user id={w};password={_mark(p)};\";"],
        "trailing comment": [f"{n}: {_mark(p)}  # prod", f"export {word.upper()}={_mark(k)} # {v}", f"{n} = {_mark(p)} // {w}"],
        "passphrase": [f'{word} = "{_mark(_phrase(r))}"', f"    passphrase: '{_mark(_phrase(r))}',"],
        "option": [f'subprocess.run("mysqldump --user {w} --password {_mark(p)} {v}", shell=True)', f"RUN {v}-cli --token={_mark(k)} sync", f'sh("curl -u {w}:{_mark(p)} https://{v}.example/")', f"curl -u {w}:{_mark(p)} https://{v}.example/"],
        "element": [f"<password>{_mark(p)}</password>", f"  <clientSecret>{_mark(k)}</clientSecret>"],
        "netrc": [f"machine {v}.example login {w} password {_mark(p)}"],
        "split literal": [f'{word} = "{_mark(p[:4])}" + "{_mark(p[4:])}"', f'val {word} = "{_mark(k[:9])}" + "{_mark(k[9:20])}" + "{_mark(k[20:])}"'],
        "known format": [f'client = make("{_mark("sk-" + _random(r, 40))}")', f'maps("{_mark("AIza" + _random(r, 35))}")', f'x = "{_mark("ghp_" + _random(r, 36))}"'],
        "call": [f'client.login("{w}", "{_mark(p)}")'],
        "nothing": [f'dsn = "host={v} user={w} dbname=x"', f'"Server={v};Uid=sa;Pwd=;"', f"{n}: ${{{v.upper()}}}  # prod", f'sh("{v} --password $PASS")', "<password>changeme</password>", f"<token></token>", f'{w} = "{_sentence(r)}"', f'client.login("{w}", password)', f'x = "{_hex(r, 40)}"', f'hash = "{k}"'],
    }
    form = r.choice(list(forms))
    return form, r.choice(forms[form])


def labelled(text: str) -> tuple[list[Token], list[int], list[bool]]:
    """The tokens of a marked line, their labels, and which characters are credentials."""
    plain, inside = [], []
    flag = False
    for c in text:
        if c in "\x02\x03":
            flag = c == "\x02"
            continue
        plain.append(c)
        inside.append(flag)
    found = tokens("".join(plain))
    return found, [int(t.end > t.start and all(inside[t.start : t.end])) for t in found], inside


def _nothing(r: random.Random) -> tuple[list[str], list[int], list[list[str]]]:
    """Links, labels and features of tokens as they occur on lines without a trigger, in any combination: no credential is among them."""
    n, name = r.choice([1, 1, 2, 3, 5]), r.choice(["neutral", "neutral", "other"])
    shapes = [r.choice([s for s in SHAPES if s != "format"]) for _ in range(n)]
    context = r.choice(["value", "phrase"]) if n > 1 else r.choice(["value", "phrase", "words", "code", "query", "flag", "element"])
    sense = r.choice(SENSES[1:]) if context == "phrase" else r.choice(SENSES) if context == "element" else "single"
    links = ["apart", *[r.choice(["same", "joined"]) for _ in range(n - 1)]]
    made = [features(shapes[i], name, context, r.choice(SIZES), sense, links[i], False, shapes[i - 1] if i else "", shapes[i + 1] if i + 1 < n else "") for i in range(n)]
    return links, [0] * n, made


def train(seed: int = 1, lines: int = LINES, rounds: int = 10, rate: float = 0.12, decay: float = 2e-4) -> Field_:
    """Stochastic gradient ascent on the conditional log-likelihood, by forward and backward sums."""
    r = random.Random(seed)
    data = [labelled(line(r)) for _ in range(lines)]
    made = [([t.link for t in found], labels, [features(*d) for d in described(found)]) for found, labels, _ in data if found]
    made += [_nothing(r) for _ in range(lines // 2)]
    weights: dict[str, float] = {}
    steps = {k: [[0.0, 0.0], [0.0, 0.0]] for k in LINKS}
    for k in range(rounds):
        r.shuffle(made)
        eta = rate / (1 + k)
        for links, labels, names in made:
            emit = [(0.0, sum(weights.get(f, 0.0) for f in fs)) for fs in names]
            n = len(links)
            step = [steps[k] for k in links]
            alpha = [emit[0]]
            for i in range(1, n):
                alpha.append(tuple(_sum(alpha[-1][0] + step[i][0][y], alpha[-1][1] + step[i][1][y]) + emit[i][y] for y in (0, 1)))
            beta = [(0.0, 0.0)] * n
            for i in range(n - 1, 0, -1):
                beta[i - 1] = tuple(_sum(step[i][x][0] + emit[i][0] + beta[i][0], step[i][x][1] + emit[i][1] + beta[i][1]) for x in (0, 1))
            z = _sum(alpha[-1][0], alpha[-1][1])
            for i in range(n):
                p = math.exp(min(0.0, alpha[i][1] + beta[i][1] - z))
                g = eta * (labels[i] - p)
                if abs(g) > 1e-6:
                    for f in names[i]:
                        weights[f] = weights.get(f, 0.0) * (1 - eta * decay) + g
                if i:
                    for x in (0, 1):
                        for y in (0, 1):
                            p = math.exp(min(0.0, alpha[i - 1][x] + step[i][x][y] + emit[i][y] + beta[i][y] - z))
                            step[i][x][y] += eta * ((labels[i - 1] == x and labels[i] == y) - p)
    return Field_({f: round(w, 3) for f, w in weights.items() if abs(w) >= 0.001}, {k: [[round(v, 3) for v in row] for row in s] for k, s in steps.items()}).closed()


def _sum(a: float, b: float) -> float:
    m = max(a, b)
    return m + math.log(math.exp(a - m) + math.exp(b - m))


def accuracy(field: Field_, seed: int = 2, lines: int = 1500) -> float:
    """The share of held-out lines of the training's forms whose credential characters are exactly those labelled."""
    r = random.Random(seed)
    return sum(_exact(field, line(r)) for _ in range(lines)) / lines


def recall(field: Field_, seed: int = 3, lines: int = 2000) -> dict[str, float]:
    """Per form kept out of training the share of lines whose credential characters are exactly those labelled."""
    r = random.Random(seed)
    right: dict[str, list[bool]] = {}
    for _ in range(lines):
        form, text = unseen(r)
        right.setdefault(form, []).append(_exact(field, text))
    return {form: sum(x) / len(x) for form, x in sorted(right.items())}


def _exact(field: Field_, text: str) -> bool:
    """Whether every character of a credential, and no other but blanks between its words, is labelled. Characters that are in no token count as missed."""
    found, _, inside = labelled(text)
    plain = text.replace("\x02", "").replace("\x03", "")
    got = [False] * len(inside)
    for t, y in zip(found, field.viterbi(found)):
        if y:
            got[t.start : t.end] = [True] * (t.end - t.start)
    return all(a == b or plain[i].isspace() for i, (a, b) in enumerate(zip(got, inside)))


if __name__ == "__main__":
    best = train()
    MODEL.write_text(json.dumps({"weights": dict(sorted(best.weights.items())), "steps": best.steps}, indent=1) + "\n")
    print(len(best.weights), best.steps, "accuracy", accuracy(best), "margin", best.least_margin())
    print(recall(best))
