"""What a Python worker keeps from task to task: models that are dear to load. Spark reuses its workers, so a model loaded
for one task serves the next ones of the same worker."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

#: Bytes of models that a worker holds; what was used least recently goes first. Models tell their size as ``nbytes``; of those
#: that don't, at most MOST are held.
BOUND = 2 << 30
MOST = 4
_HELD: OrderedDict[str, object] = OrderedDict()


def size(model: object) -> int:
    return int(getattr(model, "nbytes", BOUND // MOST))


def held(name: str, load: Callable[[], object]) -> object:
    """The model of that name: loaded if this worker doesn't hold it. A load that fails is tried again next time."""
    if name in _HELD:
        _HELD.move_to_end(name)
        return _HELD[name]
    model = load()
    _HELD[name] = model
    while len(_HELD) > 1 and sum(map(size, _HELD.values())) > BOUND:
        _HELD.popitem(last=False)
    return model
