"""Settings of embedding and answering models, and the hooks that supply them.

No remote model is called from here: a name is registered with a factory that
takes checked settings and returns the provider; a local hashing embedder is in
the tree under the name ``hashing``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any, Protocol

from ..operators import vector

# Provider names, other spellings of them, and limits per provider.
EMBEDDING_PROVIDERS = ["openai", "azure", "huggingface", "ollama", "google", "deepseek", "qwen", "zhipu", "baichuan", "cohere", "mistral", "jina"]
GENERATION_PROVIDERS = ["openai", "azure", "huggingface", "ollama", "deepseek", "google", "qwen"]
ALIASES = {"azure_openai": "azure", "hf": "huggingface", "gemini": "google"}
BATCH_LIMITS = {"qwen": 10}
DEFAULTS = {"azure": {"api_version": "2024-02-01"}, "ollama": {"api_base": "http://localhost:11434"}}


@dataclass(frozen=True)
class ModelSettings:
    provider: str
    model_name: str
    api_key: str | None = field(default=None, repr=False)
    api_base: str | None = None
    api_version: str | None = None
    batch_size: int = 32
    max_retries: int = 3
    retry_delay: float = 1.0
    temperature: float = 0.7
    max_tokens: int | None = None
    extra: dict[str, Any] = field(default_factory=dict)

    def checked(self, known: list[str]) -> "ModelSettings":
        """A copy with the provider's own name, defaults and limits; an unknown provider or a missing part is an error."""
        name = ALIASES.get(self.provider.strip().lower(), self.provider.strip().lower())
        if name not in known:
            raise ValueError(f"unknown provider {self.provider!r}; known are {sorted(known)}")
        if not self.model_name:
            raise ValueError("model_name must not be empty")
        if self.batch_size < 1:
            raise ValueError("batch_size must be positive")
        filled = {k: v for k, v in DEFAULTS.get(name, {}).items() if not getattr(self, k)}
        out = replace(self, provider=name, batch_size=min(self.batch_size, BATCH_LIMITS.get(name, self.batch_size)), **filled)
        if name == "azure" and not out.api_base:
            raise ValueError("azure needs api_base")
        return out

    def public(self) -> dict[str, Any]:
        """What may be stored: no key."""
        return {"provider": self.provider, "model_name": self.model_name, "batch_size": self.batch_size, "temperature": self.temperature}


class Generator(Protocol):
    def generate(self, prompt: str) -> str: ...


class Registry:
    """Factories by provider name."""

    def __init__(self, names: list[str]):
        self.names = list(names)
        self.factories: dict[str, Callable[[ModelSettings], Any]] = {}

    def register(self, name: str, factory: Callable[[ModelSettings], Any]) -> None:
        name = name.strip().lower()
        if name not in self.names:
            self.names.append(name)
        self.factories[name] = factory

    def available(self) -> list[str]:
        """Names that can be used now, of all known in ``names``."""
        return sorted(self.factories)

    def create(self, settings: ModelSettings) -> Any:
        settings = settings.checked(self.names)
        if settings.provider not in self.factories:
            raise LookupError(f"no factory is registered for {settings.provider!r}")
        return self.factories[settings.provider](settings)


embedders = Registry(EMBEDDING_PROVIDERS)
embedders.register("hashing", lambda s: vector.HashingEmbedder(int(s.extra.get("size", 64))))
generators = Registry(GENERATION_PROVIDERS)
