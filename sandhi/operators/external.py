"""External models as a dataflow: requests with keys, a cache of responses, batches of misses.

A backend is any object with ``generate(prompts) -> responses``, order kept; it is built once a task from
its registered name. Results carry the request's key, never a position.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BACKENDS: dict[str, Callable] = {}


def register(name: str):
    def add(build: Callable) -> Callable:
        BACKENDS[name] = build
        return build

    return add


def build_backend(name: str, **options):
    """A registered backend; callers pass every backend the same options, and those it does not take are dropped."""
    return builder(name)(**{k: v for k, v in options.items() if k not in UNUSED.get(name, ())})


def builder(name: str) -> Callable:
    if name not in BACKENDS:
        raise ValueError(f"unknown backend {name!r}; one of {sorted(BACKENDS)}")
    return BACKENDS[name]


#: options that a backend does not take
UNUSED = {"transformers": ("filename",)}


@register("echo")
class Echo:
    """Canned responses by prompt, else a prefix and the prompt itself; other options are ignored."""

    def __init__(self, answers: dict[str, str] | None = None, prefix: str = "", **_: object) -> None:
        self.model_id, self.answers, self.prefix = "echo", answers or {}, prefix

    def generate(self, prompts: list[str]) -> list[str]:
        return [self.answers.get(p, self.prefix + p) for p in prompts]


class Generator:
    """A text model of a library that may not be installed: ``load`` gives its text -> text function, once a task."""

    def __init__(self, model_id: str, filename: str | None = None, load: Callable[..., Callable[[str], str]] | None = None, **options: object) -> None:
        self.model_id, self.filename, self.options = model_id, filename, options
        self._load, self._model = load or self.load, None

    def load(self) -> Callable[[str], str]:
        raise NotImplementedError

    def generate(self, prompts: list[str]) -> list[str]:
        self._model = self._model or self._load()
        return [self._model(p) for p in prompts]


@register("transformers")
class Transformers(Generator):
    def load(self) -> Callable[[str], str]:
        try:
            from transformers import pipeline
        except ImportError as e:
            raise RuntimeError("the backend transformers needs that package") from e
        pipe = pipeline("text-generation", model=self.model_id, **self.options)
        return lambda p: pipe(p, return_full_text=False)[0]["generated_text"]


@register("llamacpp")
class LlamaCpp(Generator):
    def load(self) -> Callable[[str], str]:
        try:
            from llama_cpp import Llama
        except ImportError as e:
            raise RuntimeError("the backend llamacpp needs the package llama_cpp") from e
        model = Llama.from_pretrained(repo_id=self.model_id, filename=self.filename, **self.options)
        return lambda p: model.create_chat_completion([{"role": "user", "content": p}])["choices"][0]["message"]["content"]


def split_cache(requests: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(hits with response, misses); equal requests are asked once."""
    hits = requests.join(cache.select(key, "response"), key)
    misses = requests.join(cache.select(key), key, "left_anti").dropDuplicates([key])
    return hits, misses


def generate(misses: DataFrame, backend: str, batch: int = 32, **options) -> DataFrame:
    """(key, prompt) to (key, response): prompts of like length together, batches of the given size. The name
    is looked up here, as tasks may not know of backends registered by the caller."""
    build = builder(backend)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = build(**options)
        for b in batches:
            keys, prompts = b.column(0), b.column(1).to_pylist()
            got: list[str] = []
            for i in range(0, len(prompts), batch):
                part = model.generate(prompts[i : i + batch])
                if len(part) != len(prompts[i : i + batch]):
                    raise ValueError("a backend must answer every prompt once")
                got.extend(part)
            yield pa.RecordBatch.from_arrays([keys, pa.array(got, pa.string())], ["key", "response"])

    rows = misses.select("key", "prompt").sortWithinPartitions(F.length("prompt"))
    return rows.mapInArrow(run, "key string, response string")


def respond(requests: DataFrame, cache: DataFrame, backend: str, **options) -> tuple[DataFrame, DataFrame]:
    """(key, response) of every request, and what is new for the cache."""
    from sandhi.runtime import materialize

    hits, misses = split_cache(requests.select("key", "prompt"), cache)
    new = materialize(generate(misses, backend, **options), "responses")
    return requests.select("key").join(cache.select("key", "response").unionByName(new), "key"), new
