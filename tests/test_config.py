import json

import pytest

from umbra import cli
from umbra.functions import model
from umbra.plans import config as c

TOML = '[umbra]\ndefault_strategy = "redact"\n\n[entities.EMAIL]\nthreshold = 0.9\n\n[custom.EMPLOYEE_ID]\npattern = "EMP-\\\\d{6}"\nscore = 0.8\n\n[exclusions]\nvalues = ["a@b.org"]\n'


@pytest.fixture
def file(tmp_path):
    p = tmp_path / ".umbrarc"
    p.write_text(TOML)
    return p


def resolve(path=None, sets=(), environ=None, **k):
    return c.resolve_config(config=path, sets=list(sets), environ=environ or {}, **k)


def test_layers_and_provenance(file, tmp_path):
    r = resolve(file, ["umbra.default_strategy=mask"], {"UMBRA_ENTITIES__EMAIL__THRESHOLD": "0.7", "UMBRA_PACKS": "intl", "UMBRA_HASH_KEY": "00"}, home=tmp_path)
    assert r.data["umbra"] == {"packs": ["intl"], "default_strategy": "mask"} and r.data["entities"]["EMAIL"]["threshold"] == 0.7
    assert r.provenance["umbra", "default_strategy"][0] == "cli" and r.provenance["entities", "EMAIL", "threshold"] == ("env", "UMBRA_ENTITIES__EMAIL__THRESHOLD")
    assert r.provenance["exclusions", "values"] == ("project", ".umbrarc:12") and r.provenance["exclusions", "patterns"][0] == "default"


def test_all_problems_with_lines_and_hints(tmp_path):
    p = tmp_path / "bad.toml"
    p.write_text('[umbra]\ndefault_stratgy = "mask"\n[entities.EMAIL]\nthreshold = 2\n[entities.aadhaar]\nenabled = true\n[custom.X]\npattern = "(a+)+"\n[exclusions]\nvalues = 3\n')
    with pytest.raises(c.ConfigError) as e:
        resolve(p, home=tmp_path)
    text = str(e.value)
    assert "bad.toml:2: umbra.default_stratgy - unknown key (did you mean 'default_strategy'?)" in text and "between 0.0 and 1.0" in text and "UPPER_SNAKE" in text and "missing required field 'score'" in text and "unbounded repeat" in text and "list of strings" in text


def test_formats_give_the_same(tmp_path, file):
    want = c.load_file(file)[0]
    (tmp_path / "x.json").write_text(json.dumps(want, indent=1))
    data, lines = c.load_file(tmp_path / "x.json")
    assert data == want and lines["umbra", "default_strategy"] == "x.json:3"
    yaml = pytest.importorskip("yaml")
    (tmp_path / "x.yaml").write_text(yaml.safe_dump(want))
    assert c.load_file(tmp_path / "x.yaml")[0] == want
    (tmp_path / "y.json").write_text("[1]")
    (tmp_path / "z.toml").write_text("= 1")
    for n in ("y.json", "z.toml"):
        with pytest.raises(c.ConfigError):
            c.load_file(tmp_path / n)


def test_discovery(tmp_path):
    home = tmp_path / "home"
    inner = home / "repo" / "a" / "b"
    inner.mkdir(parents=True)
    (home / ".umbrarc").write_text("")
    assert c.project_file(inner, home) is None
    (home / "repo" / ".umbrarc.toml").write_text("")
    assert c.project_file(inner, home).name == ".umbrarc.toml"
    (inner / ".git").mkdir()
    assert c.project_file(inner, home) is None
    (home / ".config" / "umbra").mkdir(parents=True)
    (home / ".config" / "umbra" / "config.json").write_text("{}")
    assert c.user_file(home).name == "config.json"


def test_bad_layers():
    with pytest.raises(c.ConfigError):
        c.env_layer({"UMBRA_NO__SUCH": "1"})
    for bad in ("a", "umbra.nothing=1", "=2"):
        with pytest.raises(c.ConfigError):
            c.set_layer([bad])
    assert c.scalar("a, b") == ["a", "b"] and c.scalar("0.5") == 0.5 and c.scalar("x") == "x"


def test_compiled_configuration_detects(file, tmp_path):
    r = resolve(file, home=tmp_path)
    d, p = c.compile_config(r)
    assert model.mask("EMP-123456, a@b.org, c@d.org", d, p)[0] == "[REDACTED_EMPLOYEE_ID], a@b.org, [REDACTED_EMAIL]"
    assert not c.is_noop(r) and c.is_noop(resolve(start=tmp_path / "none", home=tmp_path))
    assert resolve(None, ["entities.EMIAL.enabled=false"], start=tmp_path / "none", home=tmp_path).warnings == ["entities.EMIAL - no recognizer of this name (did you mean 'EMAIL'?)"]


def test_cli(file, tmp_path, capsys, monkeypatch):
    monkeypatch.setenv("HOME", str(tmp_path))
    assert cli.main(["config", "validate", "--config", str(file)]) == 0
    assert cli.main(["config", "show", "--resolved", "--config", str(file)]) == 0
    out = capsys.readouterr().out
    assert "a@b.org" not in out and "a*****g" in out and "# project .umbrarc:2" in out
    assert cli.main(["config", "validate", "--set", "entities.EMAIL.strategy=hsah"]) == 1
    assert "did you mean 'hash'" in capsys.readouterr().err
