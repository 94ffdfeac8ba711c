"""A reader for the subset of HOCON that configurations use; dotted keys, comments, nested objects, lists."""

from __future__ import annotations

import re
from typing import Any

_TOKEN = re.compile(r'\s*(?:(?P<skip>(?:#|//)[^\n]*)|(?P<punct>[{}\[\],:=])|(?P<nl>\n)|"(?P<str>(?:[^"\\]|\\.)*)"|(?P<bare>(?:[^\s{}\[\],:=#"/]|/(?!/))+))', re.S)
_INLINE = re.compile(r"[ \t\r]*")


def _tokens(text: str):
    at = 0
    while at < len(text):
        at = _INLINE.match(text, at).end()
        if at >= len(text):
            break
        if text[at] == "\n":
            yield "nl", "\n"
            at += 1
            continue
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"can't read the configuration at {text[at:at + 30]!r}")
        at = m.end()
        if m["skip"] is None:
            kind = m.lastgroup
            yield kind, (re.sub(r"\\(.)", r"\1", m["str"]) if kind == "str" else m[kind])


def _scalar(text: str) -> Any:
    low = text.lower()
    if low in ("true", "false"):
        return low == "true"
    if low == "null":
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


class _Reader:
    def __init__(self, text: str):
        self.t, self.i = [*_tokens(text), ("end", "")], 0

    def peek(self, skip: bool = True):
        while skip and (self.t[self.i][0] == "nl" or self.t[self.i] == ("punct", ",")):
            self.i += 1
        return self.t[self.i]

    def take(self, skip: bool = True):
        got = self.peek(skip)
        self.i += 1
        return got

    def fields(self, end: tuple) -> dict:
        out: dict = {}
        while self.peek() != end:
            kind, key = self.take()
            if kind not in ("bare", "str"):
                raise ValueError(f"a key was expected, not {key!r}")
            if self.peek() == ("punct", "{"):
                value = self.value()
            else:
                sep = self.take()
                if sep not in (("punct", ":"), ("punct", "=")):
                    raise ValueError(f"':' or '=' was expected behind {key!r}")
                value = self.value()
            put(out, key if kind == "bare" else [key], value)
        self.i += 1
        return out

    def value(self) -> Any:
        kind, text = self.take()
        if (kind, text) == ("punct", "{"):
            return self.fields(("punct", "}"))
        if (kind, text) == ("punct", "["):
            out = []
            while self.peek() != ("punct", "]"):
                out.append(self.value())
            self.i += 1
            return out
        if kind == "str":
            return text
        words = [text]
        while self.t[self.i][0] == "bare":
            words.append(self.t[self.i][1])
            self.i += 1
        return _scalar(" ".join(words))


def put(config: dict, key: str | list[str], value: Any) -> None:
    """Sets a dotted key; objects are merged."""
    path = key if isinstance(key, list) else key.split(".")
    for k in path[:-1]:
        config = config.setdefault(k, {})
    old = config.get(path[-1])
    if isinstance(old, dict) and isinstance(value, dict):
        for k, v in value.items():
            put(old, [k], v)
    else:
        config[path[-1]] = value


def get(config: dict, key: str, default: Any = None) -> Any:
    for k in key.split("."):
        if not isinstance(config, dict) or k not in config:
            return default
        config = config[k]
    return default if config == "???" else config


def read_config(text: str, overrides: dict[str, Any] | None = None) -> dict:
    """Nested dicts of the text; ``overrides`` maps dotted keys to values."""
    r = _Reader(text)
    if r.peek() == ("punct", "{"):
        r.i += 1
        out = r.fields(("punct", "}"))
    else:
        out = r.fields(("end", ""))
    for k, v in (overrides or {}).items():
        put(out, k, v)
    return out


#: Every key that a configuration may have; a name with .* takes anything below it.
KEYS = """fs_scheme verbose type model_name model_type k tree_num learning_rate instance_sample_rate feature_sample_rate uniform_base_prediction
sample_dependent_base_prediction leaf_random_init_range bias_need_latent_factor
data.train.data_path data.train.max_error_tol data.test.data_path data.test.max_error_tol data.delim.x_delim data.delim.y_delim
data.delim.features_delim data.delim.feature_name_val_delim data.delim.field_delim data.field_delim data.max_feature_dim data.y_sampling
data.assigned data.unassigned_mode
feature.feature_hash.need_feature_hash feature.feature_hash.bucket_size feature.feature_hash.seed feature.feature_hash.feature_prefix
feature.transform.switch_on feature.transform.mode feature.transform.scale_range.min feature.transform.scale_range.max
feature.transform.include_features feature.transform.exclude_features feature.filter_threshold feature.split_type feature.approximate feature.missing_value
model.data_path model.delim model.need_dict model.dict_path model.dump_freq model.need_bias model.bias_feature_name model.continue_train
model.feature_importance_path model.field_dict_path
loss.loss_function loss.evaluate_metric loss.just_evaluate loss.regularization.l1 loss.regularization.l2
optimization.optimizer optimization.line_search.* optimization.tree_maker optimization.tree_grow_policy optimization.round_num optimization.max_depth
optimization.max_leaf_cnt optimization.min_child_hessian_sum optimization.min_split_loss optimization.min_split_samples optimization.max_abs_leaf_val
optimization.class_num optimization.sigmoid_zmax optimization.lad_refine_appr optimization.histogram_pool_capacity optimization.watch_train
optimization.watch_test optimization.eval_metric optimization.loss_function optimization.just_evaluate optimization.uniform_base_prediction
optimization.sample_dependent_base_prediction optimization.instance_sample_rate optimization.feature_sample_rate
optimization.regularization.learning_rate optimization.regularization.l1 optimization.regularization.l2
hyper.switch_on hyper.restart hyper.mode hyper.hoag.* hyper.grid.l1 hyper.grid.l2
random.mode random.seed random.normal.mean random.normal.std random.uniform.range_start random.uniform.range_end""".split()


def check_keys(config: dict) -> None:
    """Fails on keys that mean nothing: a misspelt one would otherwise be ignored."""
    open_ended = tuple(k[:-1] for k in KEYS if k.endswith(".*"))

    def walk(part: dict, at: str):
        for k, v in part.items():
            name = at + k
            if isinstance(v, dict):
                yield from walk(v, name + ".")
            elif name not in KEYS and not name.startswith(open_ended):
                yield name

    if unknown := sorted(walk(config, "")):
        raise ValueError(f"unknown configuration keys: {', '.join(unknown)}")
