"""Project folders and configuration: creation, validation, dotted lookup, log files. Driver side only."""

from __future__ import annotations

import copy
import json
import logging
import re
import sys
import time
from pathlib import Path
from typing import Any

try:
    import yaml
except ImportError:  # JSON is YAML too; without the library only that part of it is read
    yaml = None

#: Configuration of a new project.
DEFAULTS: dict[str, Any] = {
    "paths": {"raw": "input/raw", "segments": "input/segments", "chunks": "input/chunks", "enriched": "input/enriched", "images": "input/cache/images", "index": "output/index", "image_index": "output/image_index", "logs": "logs"},
    "embedding": {"provider": "hash", "model": "", "endpoint": "", "dim": 64, "mode": "batch", "batch_size": 64, "skip_duplicates": True, "translate_query": False},
    "retrieval": {"k": 5, "strategy": "late_fusion"},
    "completion": {"model": "", "temperature": 0.7, "max_tokens": 500},
    "agents": {"image_insight": False, "output_mode": "append_to_chunk", "image_prompt": "Text beside the image:\n{{ context }}\n\nSay what the image shows and what it is good for there."},
}
_REQUIRED = ("embedding.provider", "retrieval.k", "paths.raw")
#: Model that is asked where neither a call, nor the session, nor the configuration names one. Fixed value.
DEFAULT_MODEL = "gpt-4o"


def lookup(config: dict, path: str, default: Any = None) -> Any:
    """Value at a dotted path; the default where a step is missing."""
    for key in path.split("."):
        if not isinstance(config, dict) or key not in config:
            return default
        config = config[key]
    return config


def schema() -> dict[str, dict[str, type]]:
    """The types of all settings by section."""
    return {section: {key: type(value) for key, value in values.items()} for section, values in DEFAULTS.items()}


def problems(config: dict) -> list[str]:
    """What is wrong with a configuration; empty where nothing is."""
    out = [f"section {s} is missing or no mapping" for s in DEFAULTS if not isinstance(config.get(s), dict)]
    return out + [f"{p} is missing" for p in _REQUIRED if lookup(config, p) in (None, "")]


def wrong_types(config: dict) -> list[str]:
    """Settings whose value has another type than the schema's; whole numbers pass as numbers, settings that the schema lacks as they are."""
    out = []
    for section, keys in schema().items():
        for key, kind in keys.items():
            value = lookup(config, f"{section}.{key}")
            fits = isinstance(value, int | float) if kind is float else isinstance(value, kind)
            if value is not None and (not fits or isinstance(value, bool) and kind is not bool):
                out.append(f"{section}.{key} is {type(value).__name__}, not {kind.__name__}")
    return out


def read_config(file: str | Path) -> dict:
    """A configuration file, YAML or JSON; raises FileNotFoundError, or ValueError for what is no mapping or can't be read."""
    text = Path(file).read_text(encoding="utf-8")
    try:
        config = yaml.safe_load(text) if yaml else json.loads(text)
    except Exception as e:
        raise ValueError(f"{file} can't be read: {e}") from e
    if not isinstance(config, dict):
        raise ValueError(f"{file} holds no mapping")
    return config


def check_file(file: str | Path) -> list[str]:
    """What is wrong with a configuration file; empty where nothing is."""
    try:
        config = read_config(file)
    except (FileNotFoundError, ValueError) as e:
        return [str(e)]
    return problems(config) + wrong_types(config)


def secure_name(name: str) -> str:
    """A name that is safe as that of a folder: ASCII letters, digits, '_', '-' and '.' alone, blanks as '_', no leading dots."""
    plain = re.sub(r"[^A-Za-z0-9_.-]", "", "_".join(name.replace("/", " ").replace("\\", " ").split()))
    return plain.strip("._")


class Project:
    """A folder with its configuration file, config.yml (or config.json)."""

    def __init__(self, root: str | Path):
        self.root = Path(root)
        files = [self.root / n for n in ("config.yml", "config.json")]
        self.file = next((f for f in files if f.exists()), files[0])
        self.config = read_config(self.file)

    @classmethod
    def create(cls, folder: str | Path, name: str, **settings: dict) -> Project:
        """A new project; settings: sections whose values replace the defaults. Raises ValueError for a bad name and FileExistsError where it exists.

        A name has 2 to 50 letters, digits, blanks, hyphens and underscores."""
        name = name.strip()
        if not (2 <= len(name) <= 50 and re.fullmatch(r"[a-zA-Z0-9_\-\s]+", name)):
            raise ValueError(f"bad project name {name!r}")
        root = Path(folder) / secure_name(name)
        root.mkdir(parents=True)
        config = copy.deepcopy(DEFAULTS)
        for section, values in settings.items():
            config.setdefault(section, {}).update(values)
        text = yaml.safe_dump(config, sort_keys=False, allow_unicode=True) if yaml else json.dumps(config, indent=2)
        (root / "config.yml").write_text(text, encoding="utf-8")
        project = cls(root)
        for key in config["paths"]:
            project.path(key).mkdir(parents=True, exist_ok=True)
        return project

    def path(self, key: str) -> Path:
        return self.root / lookup(self.config, f"paths.{key}", lookup(DEFAULTS, f"paths.{key}"))

    def partition(self, key: str, doc_type: str) -> Path:
        """Folder of one document type within a table."""
        return self.path(key) / f"doc_type={doc_type}"

    def log_path(self, name: str = "app", run_id: str | None = None) -> Path:
        return log_path(self.path("logs"), name, run_id)

    def held(self, key: str) -> bool:
        """Whether a table or folder holds anything but marks of an ended job."""
        return self.path(key).exists() and any(x.name[0] not in "._" for x in self.path(key).iterdir())

    def missing(self) -> list[str]:
        """Stages without results yet."""
        return [k for k in ("raw", "chunks", "index") if not self.held(k)]

    def readiness(self) -> list[str]:
        """What a question still needs; empty where everything is there."""
        out = [] if self.file.exists() and not problems(self.config) else ["config"]
        return out + [k for k in ("chunks", "index") if not self.held(k)]

    def preconditions(self, steps: list[str], query: str = "") -> tuple[list[str], list[str]]:
        """(errors, warnings) before some steps are run, by what is there and what the steps themselves will make."""
        errors, warnings, made = [], [], set()
        makes = {"ingest": "segments", "chunk": "chunks", "enrich": "enriched", "index_images": "image_index", "embed": "index"}
        have = lambda key: key in made or self.held(key)
        for step in steps:
            if step == "ingest" and not self.held("raw"):
                warnings.append("ingest: there are no raw files")
            elif step == "chunk" and not have("segments"):
                warnings.append("chunk: nothing has been ingested")
            elif step == "enrich" and not have("chunks"):
                warnings.append("enrich: there are no chunks")
            elif step == "index_images" and not have("enriched"):
                warnings.append("index_images: there are no enriched chunks")
            elif step == "embed" and not have("chunks") and not have("enriched"):
                errors.append("embed: there are no chunks")
            elif step in ("retrieve", "ask"):
                if not have("index"):
                    errors.append(f"{step}: there is no index")
                if not query.strip():
                    errors.append(f"{step}: there is no query")
            made.add(makes.get(step, ""))
        return errors, warnings


def chosen_model(call: str | None = None, session: str | None = None, config: dict | None = None) -> str:
    """The model to ask: that of the call, else of the session, else of the configuration, else the default."""
    return call or session or lookup(config or {}, "completion.model") or DEFAULT_MODEL


def log_path(root: str | Path, name: str = "app", run_id: str | None = None) -> Path:
    """<root>/<name>.log, or <root>/runs/<run_id>/<name>.log; its folder is made."""
    path = Path(root) / "runs" / run_id / f"{name}.log" if run_id else Path(root) / f"{name}.log"
    path.parent.mkdir(parents=True, exist_ok=True)
    return path


class JsonLines(logging.Formatter):
    """One JSON object a record; the record's extra_data is merged in at the top."""

    def format(self, record: logging.LogRecord) -> str:
        stamp = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(record.created))
        return json.dumps({"timestamp": stamp, "level": record.levelname, "logger": record.name, "message": record.getMessage()} | (getattr(record, "extra_data", None) or {}), default=str)


_MADE: dict[str, logging.Logger] = {}


def run_logger(name: str, file: str | Path, run_id: str | None = None, level: str = "DEBUG", as_json: bool = False) -> logging.Logger:
    """The logger of a name and run, made once: it writes to a file (as JSON lines, if asked for) and to standard output."""
    key = f"{name}-{run_id}" if run_id else name
    if key not in _MADE:
        log, plain = logging.getLogger(key), logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s")
        log.setLevel(level.upper())
        log.propagate = False
        Path(file).parent.mkdir(parents=True, exist_ok=True)
        for handler, form in ((logging.FileHandler(file, encoding="utf-8"), JsonLines() if as_json else plain), (logging.StreamHandler(sys.stdout), plain)):
            handler.setFormatter(form)
            log.addHandler(handler)
        _MADE[key] = log
    return _MADE[key]


class Fixed(logging.LoggerAdapter):
    """A logger whose fixed fields win over a call's extra_data."""

    def process(self, msg, kwargs):
        extra = dict(kwargs.pop("extra_data", None) or {}) | self.extra
        return msg, kwargs | {"extra": {"extra_data": extra}}


def logger(name: str, file: str | Path | None = None, **fixed: Any) -> logging.LoggerAdapter:
    """A logger that writes JSON lines to a file, or to standard error; fixed fields win over a call's extra_data."""
    log = logging.getLogger(f"folioflux.{name}")
    if not log.handlers:
        handler = logging.FileHandler(file) if file else logging.StreamHandler()
        handler.setFormatter(JsonLines())
        log.addHandler(handler)
        log.setLevel(logging.INFO)
    return Fixed(log, fixed)
