"""Golden documents and their expected segments, lengths,
ranges, batches and renderings, typed inline as read from the reference's
tests (they must equal the reference's results)."""

BASE = """# level one
one paragraph `Inline code`
```RUST
code block
```

> quote block

<a>A</a>"""

BASE_SEGMENTS = ["level one", "one paragraph `Inline code`", "quote block", "A"]

IO_EVENT_QUEUE = """
# I/O event queue

We add the `callback_id` to the collection of callbacks to run. We pass
in `Js::Undefined` since we'll not actually pass any data along here. You'll see
why when we reach the [Http module](./8_3_http_module.md) chapter, but the main
point is that the I/O queue doesn't return any data itself, it just tells us that
data is ready to be read.

```rust, ignored
fn process_epoll_events(&mut self, event_id: usize) {
    self.callbacks_to_run.push((event_id, Js::Undefined));
    self.epoll_pending_events -= 1;
}
```


Hi!
你好！这里是中文！



> Hi!
> **Why even keep track of how many `epoll_events` are pending?**
> We don't use this value here, but I added it to make it easier to create
> some `print` statements showing the status of our runtime at different points.
> However, there are good reasons to keep track of these events even if we don't use them.
>
> One area we're taking shortcuts on all the way here is security. If someone were
> to build a public facing server out of this, we need to account for slow networks
> and malicious users.
"""

IO_SEGMENTS = [
    "I/O event queue",
    "We add the `callback_id` to the collection of callbacks to run. We pass in `Js::Undefined` since we'll not actually pass any data along here. You'll see why when we reach the Http module chapter, but the main point is that the I/O queue doesn't return any data itself, it just tells us that data is ready to be read.",
    "Hi! 你好！这里是中文！",
    "Hi! Why even keep track of how many `epoll_events` are pending? We don't use this value here, but I added it to make it easier to create some `print` statements showing the status of our runtime at different points. However, there are good reasons to keep track of these events even if we don't use them.",
    "One area we're taking shortcuts on all the way here is security. If someone were to build a public facing server out of this, we need to account for slow networks and malicious users.",
]
IO_RANGES = [(16, 16, 0, 16), (317, 317, 16, 333), (14, 32, 333, 365), (305, 305, 365, 670), (184, 184, 670, 854)]
# (unit, limit) -> batch number of each of the five segments
IO_BATCHES = {
    ("bytes", 0): [0, 1, 2, 3, 4],
    ("chars", 0): [0, 1, 2, 3, 4],
    ("bytes", 16): [0, 1, 2, 3, 4],
    ("bytes", 400): [0, 0, 0, 1, 2],
    ("bytes", 1024): [0, 0, 0, 0, 0],
    ("chars", 347): [0, 0, 0, 1, 2],
}

TABLE = """
| Option | Description |
| ------:| -----------:|
| data   | path to data files to supply the data that will be passed into templates. |
| engine | engine to be used for processing templates. Handlebars is the default. |
| ext    | extension to be used for dest files. |
"""
TABLE_SEGMENTS = [
    "Option", "Description", "data",
    "path to data files to supply the data that will be passed into templates.",
    "engine", "engine to be used for processing templates. Handlebars is the default.",
    "ext", "extension to be used for dest files.",
]
TABLE_LENGTHS = [7, 12, 5, 74, 7, 71, 4, 37]
TABLE_RENDERED = (
    "|Option\tOption|Description\tDescription|\n"
    "| ------:| -----------:|\n"
    "|data\tdata|path to data files to supply the data that will be passed into templates.\tpath to data files to supply the data that will be passed into templates.|\n"
    "|engine\tengine|engine to be used for processing templates. Handlebars is the default.\tengine to be used for processing templates. Handlebars is the default.|\n"
    "|ext\text|extension to be used for dest files.\textension to be used for dest files.|"
)

LINKS = """
[link text](http://dev.nodeca.com)

[link with title](http://nodeca.github.io/pica/demo/ "title text!")

Autoconverted link https://github.com/nodeca/pica

![Minion](https://octodex.github.com/images/minion.png)

![Stormtroopocat](https://octodex.github.com/images/stormtroopocat.jpg "The Stormtroopocat")

### [Emojies](https://github.com/markdown-it/markdown-it-emoji)

Footnote 1 link[^first].

[^first]: Footnote **can have markup**

[<img alt="license" src="https://img.example.com/license.svg?color=blue" height="20">](https://example.com/project)

[![](https://img.example.com/downloads.svg?label=downloads&style=social)](https://example.com/package)
"""
LINK_SEGMENTS = [
    "link text", "link with title", "Autoconverted link https://github.com/nodeca/pica",
    "Minion", "Stormtroopocat", "Emojies", "Footnote 1 link.", "Footnote can have markup", "", "",
]

TIGHT_LIST = """1. Lorem ipsum dolor sit amet
2. Consectetur adipiscing elit
3. Integer molestie lorem at massa

Ordered
"""
TIGHT_SEGMENTS = ["Lorem ipsum dolor sit ametConsectetur adipiscing elitInteger molestie lorem at massaOrdered"]

LOOSE_LIST = """- one

- two

after
"""
LOOSE_SEGMENTS = ["one", "two", "after"]

TAIL_DOC = """# Title

- a
- b
"""

CODE_ONLY = """```rust
//! module doc comment
/// doc comment
fn main() {}
```
"""
