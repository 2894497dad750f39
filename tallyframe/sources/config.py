"""Configuration files, read on the driver."""

from __future__ import annotations

import json
import os
import re
import warnings
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

try:
    import yaml
except ImportError:  # JSON files still work
    yaml = None

_VARIABLE = re.compile(r"\$\{([^}]+)\}")
#: Display names by file name.
DISPLAY = {"gpt-4": "GPT-4 (OpenAI)", "claude-3": "Claude 3 (Anthropic)", "gemini": "Gemini (Google)", "groq": "Groq (Free)", "ollama": "Ollama (Local)", "bedrock": "Bedrock (AWS)", "together": "Together AI"}
PROVIDER = "provider_id string, name string, config_path string, provider_type string, model_name string, has_api_key boolean, tools_enabled array<string>, display_name string"

AGENT = "name string, provider string, model string, api_base string, has_key boolean, temperature double, max_tokens int, top_p double, frequency_penalty double, presence_penalty double, system_prompt string, tools array<string>, timeout int, max_retries int, thinking_budget int, ollama_host string"


def expand(value: Any, whole: bool = False) -> Any:
    """Replace ``${NAME}`` by the environment's value (absent: empty) in all texts within a value; with ``whole`` only where it is all of a text."""
    if isinstance(value, dict):
        return {k: expand(v, whole) for k, v in value.items()}
    if isinstance(value, list):
        return [expand(v, whole) for v in value]
    if not isinstance(value, str) or (whole and not _VARIABLE.fullmatch(value)):
        return value
    return _VARIABLE.sub(lambda m: os.environ.get(m[1], ""), value)


def read(path: str | Path, expanded: bool = True) -> dict[str, Any]:
    """A .yaml, .yml or .json file; an empty one is an empty mapping, another suffix an error."""
    path = Path(path)
    if path.suffix not in (".yaml", ".yml", ".json"):
        raise ValueError(f"unsupported config format: {path.suffix}")
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        found = json.loads(text) if text.strip() else {}
    elif yaml is None:
        raise RuntimeError("reading YAML needs PyYAML")
    else:
        found = yaml.safe_load(text) or {}
    return expand(found) if expanded else found


def write(path: str | Path, value: dict[str, Any]) -> None:
    """A mapping as a YAML or JSON file by suffix, names in their order."""
    path = Path(path)
    if path.suffix == ".json":
        path.write_text(json.dumps(value, ensure_ascii=False, indent=2), encoding="utf-8")
    elif path.suffix not in (".yaml", ".yml"):
        raise ValueError(f"unsupported config format: {path.suffix}")
    elif yaml is None:
        raise RuntimeError("writing YAML needs PyYAML")
    else:
        path.write_text(yaml.safe_dump(value, allow_unicode=True, sort_keys=False), encoding="utf-8")


def read_system(path: str | Path) -> dict[str, Any]:
    """The system configuration; a missing file gives a warning and an empty mapping."""
    if Path(path).is_file():
        return read(path)
    warnings.warn(f"no system configuration at {path}", stacklevel=2)
    return {}


def task_files(folder: str | Path, name: str | None = None) -> list[Path]:
    """One task's file, by path or by name within the folder, or all of the folder."""
    folder = Path(folder)
    if name is None:
        return sorted(p for p in folder.iterdir() if p.suffix in (".yaml", ".yml", ".json"))
    for path in (Path(name), *(folder / f"{name}{s}" for s in (".yaml", ".yml", ".json"))):
        if path.is_file():
            return [path]
    raise FileNotFoundError(f"no task configuration {name!r} in {folder}")


@dataclass(frozen=True)
class TaskConfig:
    """A task: what to read and how to score it."""

    name: str = "unknown"
    title: str = "Unknown Task"
    dataset: dict[str, Any] = field(default_factory=dict)
    evaluation: dict[str, Any] = field(default_factory=dict)

    @property
    def path(self) -> str:
        """Where the tasks are; empty if the configuration does not say."""
        return self.dataset.get("path") or ""

    @property
    def max_samples(self) -> int | None:
        return self.dataset.get("num_samples")

    @property
    def shuffle(self) -> bool:
        """Whether the tasks, once limited, are read in another order."""
        return bool(self.dataset.get("shuffle", False))

    @classmethod
    def of(cls, config: dict[str, Any]) -> TaskConfig:
        task = config.get("task", {})
        return cls(task.get("id", task.get("name", cls.name)), task.get("name", cls.title), config.get("dataset", {}), config.get("evaluation", {}))

    @property
    def fields(self) -> dict[str, Any]:
        return self.dataset.get("format", {})


@dataclass(frozen=True)
class AgentConfig:
    """The agent whose answers are scored, as a dimension of the results. The key itself is not kept, only whether there is one."""

    name: str = "unnamed-agent"
    provider: str = "openai"
    model: str = "gpt-4"
    api_base: str = ""
    has_key: bool = False
    temperature: float = 0.0
    max_tokens: int = 4096
    top_p: float = 1.0
    frequency_penalty: float = 0.0
    presence_penalty: float = 0.0
    system_prompt: str = ""
    tools: tuple[str, ...] = ()
    timeout: int = 300
    max_retries: int = 3
    thinking_budget: int | None = None
    ollama_host: str = "http://localhost:11434"

    @classmethod
    def of(cls, config: dict[str, Any], prompts: str | Path = "prompts/system") -> AgentConfig:
        """From an agent's file. The prompt's file is looked for among ``prompts`` unless its path is absolute; a missing one is an empty prompt."""
        config = expand(config, whole=True)
        part = lambda name: config.get(name) or {}
        model, run, own = part("model"), part("execution"), part("provider_settings")
        file = config.get("system_prompt_file")
        where = Path(prompts) / file if file else None  # an absolute path replaces the folder
        return cls(
            part("agent").get("name", cls.name), model.get("provider", cls.provider), model.get("name", cls.model), model.get("api_base", cls.api_base), has_key(model.get("api_key")),
            float(model.get("temperature", cls.temperature)), int(model.get("max_tokens", cls.max_tokens)), float(model.get("top_p", cls.top_p)), float(model.get("frequency_penalty", cls.frequency_penalty)), float(model.get("presence_penalty", cls.presence_penalty)),
            where.read_text(encoding="utf-8") if where and where.is_file() else "", tuple(part("tools").get("enabled") or ()), int(run.get("timeout", cls.timeout)), int(run.get("max_retries", cls.max_retries)), own.get("thinking_budget"), own.get("ollama_host", cls.ollama_host),
        )

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row, to be joined to results as a dimension."""
        return spark.createDataFrame([tuple(list(v) if isinstance(v, tuple) else v for v in (getattr(self, f.name) for f in fields(self)))], AGENT)


def has_key(key: str | None) -> bool:
    """Whether a key is given and is no placeholder."""
    return bool(key) and not key.startswith("${")


def discover_providers(spark: SparkSession, folder: str | Path) -> DataFrame:
    """A row for each provider file of a folder by name; the template is left out, a broken file with a warning. A missing folder has none."""
    rows = []
    for path in sorted(Path(folder).glob("*.yaml")) if Path(folder).is_dir() else []:
        if path.name != "template.yaml":
            try:
                config = read(path, expanded=False)
                model = config.get("model") or {}
                name = DISPLAY.get(path.stem, path.stem.replace("-", " ").title())
                rows.append((path.stem, name, str(path), model.get("provider", "unknown"), model.get("name", "unknown"), has_key(model.get("api_key", "")), list((config.get("tools") or {}).get("enabled", [])), f"{name} ({model.get('name', 'unknown')})"))
            except Exception as e:  # a broken file must not hide the others
                warnings.warn(f"{path} was left out: {e}", stacklevel=2)
    return spark.createDataFrame(rows, PROVIDER).orderBy("name")


def shown_tools(tools: Column | str = "tools_enabled", most: int = 3) -> Column:
    """The first tools of a provider, for a list of providers."""
    return F.slice(tools, 1, most)
