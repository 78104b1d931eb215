import pytest

from auditlake import config
from auditlake.rulesets import loader as L

HEAD = "version: 1\nrules:\n"


def rule(body, rid="a.b", extra=""):
    return f"{HEAD}  - {{id: {rid}, severity: error, message: m, {extra}{body}}}\n"


def test_kinds():
    for body in ("regex: {pattern: x}", "secret: {pattern: '(x)', group: 1, entropy: 2, keywords: [A]}", "ast: {python: '(call) @c'}", "boundary: {from: a, deny: [b]}", "coverage: {min: 80}", "duplication: {max_percent: 3, scope: file}"):
        assert len(L.load_text(rule(body)).rules) == 1
    assert L.load_text(rule("secret: {pattern: x, keywords: [ABC]}")).rules[0].keywords == ("abc",)


@pytest.mark.parametrize(
    "text,said",
    [
        ("{", "not YAML"), ("version: 2\nrules: []", "version"), ("version: 1", "missing"), ("version: 1\nrules: []\nx: 1", "unknown key"), (rule("regex: {pattern: x}", rid="ab"), "id has"),
        (rule("regex: {pattern: x}", rid="metrics.duplicate-block"), "reserved"), (rule("regex: {pattern: x}, coverage: {min: 1}"), "exactly one"), (HEAD + "  - {id: a.b, severity: error, message: m}", "exactly one"),
        (rule("regex: {pattern: '('}"), "bad pattern"), (rule("regex: {pattern: x, group: 1}"), "no group"), (rule("regex: {pattern: '(?=x)'}"), "linear-time"), (rule("regex: {pattern: x, y: 1}"), "unknown key"),
        (rule("secret: {pattern: x, entropy: -1}"), "outside"), (rule("secret: {pattern: x, entropy: .inf}"), "finite"), (rule("regex: {pattern: x}", extra="include: ['[a'], "), "unclosed"),
        (rule("ast: {python: '(call'}"), "closed"), (rule("ast: {cobol: '(x)'}"), "unknown key"), (rule("ast: {}"), "at least one"), (rule("boundary: {from: a, deny: []}"), "deny"), (rule("boundary: {from: 'a b', deny: [c]}"), "silo name"),
        (rule("coverage: {min: 101}"), "outside"), (rule("coverage: {min: 1}", extra="languages: [go], "), "languages"), (rule("duplication: {max_percent: 0}"), "outside"), (rule("duplication: {max_percent: 1, scope: x}"), "scope"),
        (rule("regex: {pattern: x}").replace("error", "bad"), "severity"), (HEAD + "  - {id: a.b, severity: error, message: m, regex: {pattern: x}}\n" * 2, "more than one"),
    ],
)
def test_errors(text, said):
    with pytest.raises(L.RuleError, match=said):
        L.load_text(text)


def test_dirs_merge_in_byte_order(tmp_path):
    (tmp_path / "b.yml").write_text(rule("regex: {pattern: x}", rid="b.b"))
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "z.yaml").write_text(rule("regex: {pattern: x}", rid="a.a"))
    rules = L.load_dirs([tmp_path])
    assert [r.id for r in rules.rules] == ["a.a", "b.b"]
    (tmp_path / "c.yaml").write_text(rule("regex: {pattern: y}", rid="a.a"))
    with pytest.raises(L.RuleError, match="more than one"):
        L.load_dirs([tmp_path])
    assert L.load_dirs([tmp_path / "a"]).digest() != rules.digest()


def test_default_pack_compiles():
    rules = L.default_rules()
    assert len(rules.rules) >= 20 and set(rules.redacted()) == {r.id for r in rules.rules}
    with pytest.raises(L.RuleError):
        L.require_rules(L.RuleSet())


def test_dialects():
    assert L.java_pattern("(?P<n>a)$") == r"(?U)(?<n>a)\z" and L.java_pattern("[$]") == "(?U)[$]"
    assert L.compiled(r"\x{E9}$").search("é") and not L.compiled("a$").search("a\n")
    assert L.lint(r"a(?!b)") and L.lint(r"(a)\1") and not L.lint(r"[(?=]\\1")


def test_config(tmp_path):
    c = config.parse('source_roots=["src"]\nanchor="config"\n[silos]\nweb=["web/**"]\n[duplication]\nmin_lines=5\nreport_blocks=true\n[limits]\nmax_parse_bytes=9\n')
    assert (c.silos, c.min_lines, c.report_blocks, c.max_parse_bytes, c.anchor) == ({"web": ["web/**"]}, 5, True, 9, "config")
    for text, said in (("x=1", "unknown"), ("[duplication]\nmin_lines=1", "at least 2"), ("[limits]\nmax_parse_bytes=0", "at least 1"), ('anchor="x"', "anchor"), ('rules=["../x"]', "leaves"), ('[silos]\n"a b"=["x"]', "silo name"), ("=", "not TOML"), ('[silos]\na=["/x"]', "leaves")):
        with pytest.raises(config.ConfigError, match=said):
            config.parse(text)


def test_include_and_discovery(tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / config.NAME).write_text('include=["mod"]\n[silos]\na=["a/**"]\n')
    mod = tmp_path / "mod" / "deep"
    mod.mkdir(parents=True)
    (tmp_path / "mod" / config.NAME).write_text('source_roots=["src"]\n[silos]\nb=["x/**"]\n')
    whole = config.load(tmp_path / config.NAME)
    assert whole.silos == {"a": ["a/**"], "b": ["mod/x/**"]} and whole.source_roots == ["mod/src"]
    assert config.discover(tmp_path / "mod").path == tmp_path / config.NAME
    assert config.discover(mod).silos == whole.silos
    whole.anchor = "config"
    assert whole.prefix(mod) == "mod/deep" and whole.prefix(tmp_path) == ""
    with pytest.raises(config.ConfigError):
        whole.prefix(tmp_path.parent)
    (tmp_path / "mod" / config.NAME).write_text("[silos]\na=['x']\n")
    with pytest.raises(config.ConfigError, match="declared"):
        config.load(tmp_path / config.NAME)
