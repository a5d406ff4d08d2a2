"""Pieces of markup that documents are derived with: each has violations beside near misses."""

SNIPPETS: list[str] = [
    # front matter, good
    '---\nseo_title: "A"\nseo_description: B\nurl: /docs/a\n---\n# Alpha Overview\n\n## Overview\n\nThis page explains the alpha service in enough words to be a lede here.\n\n## Next Steps\n\n- [Read the guide](docs/guide/doc-4.md)\n- See [the list](#overview) for more.\n',
    # front matter, bad lines and missing keys
    '---\nseo_title: A\nnot a pair\n- item\nurl: "/x"\nurl: /y\n---\n# Beta\n\nLead text.\n\n## Quick Start\n\n1. Open it.\n2. Run it.\n',
    # never closed front matter
    '---\nseo_title: A\nurl: b\n\n# Gamma\n\n## Overview\n\nText.\n',
    # fences of both characters, one nested, one in a quote
    '# Fences\n\n```js\nawait run();\n~~~\njust a test; really — fine\n```\n\n~~~\ncode — here; and seamless\n```\nstill code\n~~~\n\n> ```ts\n> call().then(x)\n> ```\n\nOutside again; really.\n',
    # unclosed fence
    '# Open Fence\n\nBefore — it.\n\n```python\nx = 1; y = 2\n',
    # dashes and semicolons, masked and not
    '# Dashes\n\nA value — with a dash.\nOne; two.\nCode `a; b — c` only.\nEntity &amp; only.\nA link [x](http://h/a;b) here.\n<img alt="a — b" src="x;y">\nRange 3–5 here.\nURL https://x.test/a;b?c done.\n',
    # emoji, arrows, substitutes
    '# Marks\n\nClick → then ✅ done.\nA · b and x ≥ 3 …\nOnly © and ® and ™ here.\nCode `→ ✅ ≥` only.\nRocket 🚀 here.\nTemperature 5° is fine.\n',
    # italics
    '# Italics\n\nA *single* word.\nAn _under line_ here.\nsnake_case_name stays and 2 * 3 * 4 too.\n<em>tag</em> here.\n**bold** only.\n\nSpan *starts here\nand ends* here.\n\nWrap *a **b** c* now.\n',
    # present continuous and passive
    '# Tense\n\nThe server is holding data and was currently sending it.\nA file is missing and remaining.\nThe value is being set.\nThe file was created by the system.\nIt can be changed later.\nThe Key Is Written Here.\nData sent by the client, returned to you.\nIt gets removed with care.\nCode `is running` only.\n',
    # casual and banned
    '# Tone\n\nThis is just a seamless and powerful tool.\nIt is not just that.\nYou will learn to leverage it out of the box.\nCode `just` only.\nThis page covers the basics.\nUnlock your data; it transforms everything.\nWe make sure it works at all.\nComing soon.\n',
    # anthropomorphism
    '# Human Words\n\nThe server decides the route.\nYou decide the route.\nThe OAuth server refuses the token.\nIgnore the value.\nThe parser ignores it and the user wants more.\nUsers decide alone.\nThe cache remembers the key.\n- **Note:** knows it all\n',
    # over-promise, vague, metaphor, periphrasis, wordy
    '# Promises\n\nNo setup needed and it never fails.\nIt always works with any tool.\nThe tree walks the ancestor locale.\nA long list of items over many pages is read in pages.\nThe output is like this:\n\n```\nx\n```\n\nThis example is shown above.\n\nUse this command\n\n- item\n\nIn practice the fact that it should be noted that helps.\n',
    # error codes
    '# Codes\n\nThe API returns 404 or 500 errors.\nUp to 200 items are fine.\nHTTP 301, 302 and 307 redirect.\nPort 443 is open.\nA 201 Created response.\nLimit of 429 requests.\nGot a 503/504 error.\nCode `404 error` only.\n',
    # how and attempts and conditional
    '# How\n\nThis shows how it works.\nHow to start.\nRead how many there are.\nIt stops after three attempts.\nIt stops after **two attempts** in total.\nIf you see an error in the log, run the tool again.\nIf you notice it, check nothing.\n',
    # sentences
    '# Sentences\n\nThe first sentence holds a great many words because it goes on and on since nobody ever stopped it so that the reader has to work hard to reach its end now. Short one. "Quoted" is fine.\n- This item runs through the list, the table, and the note, and it is long enough to be flagged by the check that counts the words of each sentence in a line of text.\n> The callout line is also rather long but it stays out of the way because it opens with a mark, and it goes on and on and on until the end of it all at last now.\nThis last one, which is long, and could be cut, and would be better so, but nobody did, and is therefore kept as an example of chained clauses that never come to an end at all in here today.\n',
    # headings
    '# Headings\n\n## Why does it work?\n\nText.\n\n## FAQ\n\n### What is it?\n\nText.\n\n## a lowercase fragment\n\nText.\n\n## And then it happened\n\nText.\n\n## This heading has far too many words\n\nText.\n\n#### Deep `code span` here now\n\nText.\n\n## npx tool\n\n## getName\n\nLink to [deep](#deep-code-span-here-now) and [why](#why-does-it-work) and [gone](#nowhere).\n',
    # root cause entries
    '# Errors\n\n## Troubleshooting\n\n### The tool prints "not_found" at all times.\n\n**Root Cause**: no file.\n\n**Resolution**: add it.\n\n### Second problem\n\n**Resolution**: wait.\n\n**Root Cause**: order.\n\n### Third problem\n\nNothing here.\n\n## Next Steps\n\n- [Bare](docs/guide/doc-8.md)\n- [Bare with dot](x.md).\n- Read [this](y.md) first.\n',
    # acronyms
    '# Acronyms\n\nThe CDN serves it. A content delivery network (CDN) is fast.\nContinuous integration (CI) first, then CI runs.\nUse `SSO` in code. The BFF/CMA pair and (CDA) too.\nSSR and server-side rendering (SSR).\n',
    # tables good and broken
    '# Tables\n\n| Name | Value |\n| --- | --- |\n| a | b |\n| c |\n| d | e | f |\n| **g | (h |\n| `x|y` | z |\n\nText.\n\n|  |  |\n| --- | --- |\n| a | b |\n\n| A |  |\n| :-- | --: |\n| \\| | [q |\n\n```\n| a | b |\n| --- | --- |\n| c |\n```\n\nOne | column\n---\n',
    # table restated
    '# Restated\n\n| Option | Meaning |\n| --- | --- |\n| Alpha mode | turns the alpha engine on for all users |\n| Beta | nothing to say |\n\n> **Note:** Turns the alpha engine on for all users.\n\n- turns the alpha engine on for all users today\n- something else entirely is said here\n\n**Alpha mode** turns the alpha engine on\n\n## After\n\n- turns the alpha engine on for all users\n',
    # quick reference
    '# Reference\n\n## Quick Reference\n\n| Use case | Section | Key call |\n| --- | --- | --- |\n| one | [A](#a) | x |\n| two | plain | y |\n\n## Quick Decision Guide\n\n| Approach | Reason |\n| --- | --- |\n| a | b |\n\n## Prerequisites\n\n- Node\n- [Account](z.md)\n',
    # quick reference without table
    '# Reference Two\n\n## Overview\n\nWords enough to be a lede: this page is for those who look things up.\n\n## Quick Reference\n\nNo table.\n\n## Main Content\n\nText.\n\n## Quick Start\n\nText.\n\n## Documentation Map\n\n- [Only](a.md)\n',
    # migration guide
    '# Upgrade to v2\n\n## Overview\n\nText.\n\n## Type Mapping Reference\n\n| Area | Old API | New API |\n| --- | --- | --- |\n| a | x, y | z |\n| b | w | v |\n\n## Main Content\n\n### Client\n\nBefore and after code.\n\n### Server\n\nOnly before.\n\n### Other\n\nNo prior equivalent.\n\n## Theory\n\nText.\n\n## Pre-Upgrade Checklist\n\n1. One\n- Two\n',
    # migration guide, poor
    '# Migrate Data\n\n## Type Mapping Reference\n\nNone.\n\n## Pre-Upgrade Checklist\n\nNone.\n\n## Prerequisites\n\nText.\n\n## Overview\n\nText.\n',
    # getting started
    '# Get Started with It\n\n## Overview\n\nText.\n\n## Prerequisites\n\n- A\n\n## Role-Based Routing Table\n\n| I want to... | Start here |\n| --- | --- |\n| a | [b](c.md) |\n\n## Quick Start\n\n1. a\n2. b\n3. c\n4. d\n5. e\n6. f\n7. g\n8. h\n9. i\n10. j\n11. Open the page.\n\n## Troubleshooting\n\nText.\n\n## Documentation Map\n\n- [x](y.md)\n',
    # getting started, good
    '# Get Started with More\n\n## Overview\n\nText.\n\n## Role-Based Routing Table\n\n| I want to... | I am... | Start here |\n| --- | --- | --- |\n| a | b | [c](d.md) |\n\n## Quick Start\n\nEstimated time: 5 minutes.\n\n1. Run it.\n2. You should see a page.\n\n## Next Steps\n\n- [x](y.md)\n',
    # cli
    '---\ntitle: T\ndescription: D\n---\n# The CLI Export Plugin\n\n## Commands\n\nRun `plugins:install` first.\n\n| Flag | Type | Description |\n| --- | --- | --- |\n| -a | x | y |\n\n```\nplain\n```\n\n```bash\ntagged\n```\n\n### Prerequisites\n\n- Node\n\n#### Deep One\n\n> **Careful**: outside colon\n\n> **Note:** fine\n\nSee https://www.example.com/docs/a here.\n\n## Troubleshooting\n\nText.\n',
    # cli module
    '# CLI Limitations\n\n## Overview\n\nText.\n\n## Quick Reference\n\n| Section |\n| --- |\n\n| Section | Note |\n| --- | --- |\n| [a](#overview) | b |\n| c | d |\n',
    # cli runbook
    '# Update Stacks with CLI\n\n## Prerequisites\n\n- A [link](a.md)\n- None\n\n## Step 1: Do\n\nText.\n\n## Step 2: Done\n\n##### Deeper\n\nText.\n',
    # callouts
    '# Callouts\n\n## One\n\nNote: a.\n**Note**: b.\n> **Note:** c.\n\n## Two\n\nRequired: a.\n\n> **Caution:** wrong label\n\n> **Additional Resource:** For more information on X, refer to the [X](x.md) documentation.\n\n> **Additional Resource:** See [X](x.md).\n\n> **Before You Begin:** fine.\n',
    # ordered lists
    '# Lists\n\nSome facts:\n\n1. Apples are red\n2. Pears are green\n3. Plums are blue\n\nDo this in order:\n\n1. Apples\n2. Pears\n\nThings:\n\n1. Open it\n2. Close it\n3. Nothing\n\n  1. Nested one\n  2. Nested two\n',
    # ui
    '# Screens\n\nOpen the `Save Draft` tab.\nThe `value` field is `API_KEY`.\nRun `Export All` later.\n\n| Button | Action |\n| --- | --- |\n| `Save Now` | saves |\n\nUse **Save** there.\n',
    # domains
    '# Domains\n\nVisit widgets.io today.\nCode `api.test.com` only.\nA link [x.com](http://x.com) and <http://y.org>.\nMail me@host.com now.\nFile a.co.uk and v1.net.x here, or host.dev, at last.\n',
    # vendors
    '# Clients\n\n## Set Up Cursor\n\nOpen **Settings** > **Tools** there.\nUse the **Connect** label.\n\n## Other\n\nOpen **Settings** > **Tools** there.\n\nWith Copilot Pro plan.\nSee [help](https://help.openai.com/en/articles) and [node](https://nodejs.org/en).\nThen **Press** it.\n\n\n\n\nFar **Label** here.\n',
    # cohesion
    '# Cohesion\n\n## Loose\n\nThis runs first. It is long.\n\nAlone here.\n\nThat goes next. It ends.\n\nThe tool works. It stops.\n\n## Tied\n\nBecause it runs, it works. Yes.\n\nWhen it stops, it ends. Yes.\n\nIf it fails, retry. Yes.\n\n## Labelled\n\n**One** a b. C.\n\nText a. B.\n\nText c. D.\n\nText e. F.\n',
    # duplicates
    '# Twins\n\n## First\n\nThe quick brown fox jumps over the lazy dog near the old river bank today.\n\n## Second\n\nThe quick brown fox jumps over the lazy dog near the old river bank today.\n\n## Third\n\nSomething else is written here and it has no likeness at all to the rest.\n\nSee [a](one.md), [b](two.md) and [c](one.md).\n',
    # uniform headings
    '# Changes\n\n## v1\n\n### Removed Options\n\nText.\n\n## v2\n\n### Removed Options\n\nText.\n\n## v3\n\n### Options Removed\n\nText.\n\n## v4\n\n### New\n\n### Removed\n\nText.\n',
    # hub
    '---\nurl: /tools/hub-page\nseo_title: x\nseo_description: y\n---\n# Hub Page\n\n## Overview\n\nText.\n\n## Troubleshooting\n\n### Entry\n\n**Root cause:** x\n\n## Next Steps\n\nSee [other](x.md).\n',
    # links
    '# Links\n\n[Guide to alpha](../guide/doc-0.md) and [deep](../guide/doc-15.md#deep-code-span-here-now).\n![Image](pic.png) and <a href="other.md">x</a>.\n[Ext](https://site.test/a) and [mail](mailto:a@b.c) and [here](//cdn.test/x).\n[Nested [label]](./doc-3.md "title") and `[code](no.md)`.\n[Weather report](../guide/doc-4.md#sentences)\n\n~~~\n[fenced](no.md)\n```\n',
    # hand-offs and house verbs
    '# Handoff\n\n## Steps\n\nThe parser holds a value, but it carries nothing.\nAsk the admin for help.\nHover the **Edit** icon.\nYou can change the name, type or value.\nMost clients call the server often.\nIt silently does nothing.\nThe route fails open and serves every user.\nYou must set `A` and `B`.\nThe tool issues for its own use a key.\n\n1. Ask for it\n2. Wait here\n\n### Limits\n\nAsk [the admin](a.md) for such as the name or type.\n',
    # overview and flow
    '# Overview First\n\n## Overview\n\nBeyond the basics, this page goes on.\n\n## Flow\n\nThe client calls the server and the browser waits.\n\n1. a\n2. b\n3. c\n\n## Options\n\nIf it runs, fine. Either way it works. Whereas it stops, alternatively it waits. Done here.\n\n## Rules\n\nAs below:\n\n- a\n\nIt is so:\n\n- b\n\nText.\n\nMore text.\n\nYou must never stop it.\n\nText.\n\nText.\n',
    # counts
    '# Counts\n\n## Three Steps\n\nThe following three options:\n\n- a\n- b\n\nUse these two tables:\n\n| A | B |\n| --- | --- |\n| a | b |\n\nTwo sections below.\n\n### X\n\nText.\n\n### Y\n\nText.\n\n### Z\n\nFour minutes here:\n\n- a\n\nBoth items here:\n\n- a\n- b\n',
]

#: Pages of an API reference by what is wrong with them: class pages, method pages, usage guides.
CLASS_PAGES: list[str] = [
    '---\nuid: a\nseo_title: "A"\nseo_description: b\n---\n# Thing\n\n## Method Index\n\n| Method Name | Use |\n| --- | --- |\n| [m1](methods/m1.md) | x |\n| [m2](methods/m2.md) | y |\n',
    '---\nuid: a\nseo_title: ""\nextra: b\n---\n# Thing\n\n### Deep\n\n| Name | Kind |\n| --- | --- |\n| a | b |\n\n## Methods\n\n- [gone](methods/gone.md)\n- [m1](methods/m1.md)\n\n---\n',
    '# One\n\n# Two\n\n## Method Index\n\n| Method Name |  Use |\n| --- | --- |\n| [m1](methods/m1.md) | x |\n| [m1](methods/m1.md) | x |\n',
]
METHOD_PAGES: list[str] = [
    '---\nuid: a\nseo_title: ""\nseo_description: ""\n---\n### m1\n\n**Returns:** Thing. The thing.\n\n| Name | Type | Required | Default | Description |\n| --- | --- | --- | --- | --- |\n| a | b | c | d | e |\n\n#### Validation\n\n> **Additional Resource:** see [x](m2.md)\n\n#### Behavior\n\n#### Example\n\n',
    '---\nuid: a\n---\n## m2\n\n### other\n\n**Returns:** nothing at all\n\n| Name | Type | Required | Default | Description |\n| --- | --- | --- | --- | --- |\n| a | b | c |  | e |\n| a | b | c | — | e |\n\n#### Example\n\n#### Validation\n\n> **Additional Resources:** see [x](gone.md)\n\n',
    '### m3\n\n| Name | Type |\n| --- | --- |\n| a | b |\n\n**Returns:** A or B. No stop\n\n#### Validation\n\nText.\n\n',
]
GUIDE_PAGES: list[str] = [
    '---\nuid: a\nseo_title: A\nseo_description: B\n---\n# Tool API Reference\n\n> **Before you begin:** see [Get Started](g.md). Requires Node 18.\n> Read the changelog.\n\n## Minimum Working Example\n\n## SDK Structure\n\n## Class Overview\n\n| Class | Role | Accessed via |\n| --- | --- | --- |\n| [k0](k0/class_reference.md) | r | `x()` |\n\n## Task Index\n\n| Task | Start here | Class |\n| --- | --- | --- |\n| Fetch it | [a](b.md) | c |\n\n## Key Usage Patterns\n\n### One\n\n### Two\n\n### Three\n\n## SDK-Wide Notes\n\n> **Warning:** token types differ.\n\n| Concern | Behavior | Default when unset |\n| --- | --- | --- |\n| a | b | c |\n',
    '---\nuid: a\nseo_title: ""\nseo_description: B\n---\n# Tool\n\n## Tool\n\n## Class Overview\n\n| Class | Role | Accessed via |\n| --- | --- | --- |\n| k0 | r | x |\n| [k9](k9/class_reference.md) | r | `x` |\n| [k9](k9/class_reference.md) | r | `x` |\n\n## SDK Structure\n\n## Task Index\n\n| Task | Start here | Class |\n| --- | --- | --- |\n| Fetching it | a | c |\n\n## Key Usage Patterns\n\n### Example\n\n#### Deep\n\n## Installation\n\nnpm install x\n\n## SDK-Wide Notes\n\n| Concern | Behavior | Default when unset |\n| --- | --- | --- |\n| a | b |  |\n\n## SDK Limitations\n\n| Capability | Supported | Notes / Alternative |\n| --- | --- | --- |\n| a | b |  |\n',
    '# Tool API Reference\n\n> **Before you begin:** nothing.\n\n## Class Overview\n\n## Task Index\n\n## SDK-Wide Notes\n\n## SDK Limitations\n\n| A | B |\n| --- | --- |\n',
]
