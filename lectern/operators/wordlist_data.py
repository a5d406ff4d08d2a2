"""Word lists: (rule, category, phrase, pattern) in the order in which a line is tried."""

# Phrases and patterns that the checks look for.

WORDLISTS: dict[str, list[tuple[str, str, str | None, str | None]]] = {
    'banned-phrases': [
        ('CLI-16', 'absent-docs', 'yet to come', None),
        ('CLI-16', 'absent-docs', 'coming soon', None),
        ('CLI-16', 'absent-docs', 'not available yet', None),
        ('C8-02', 'benefit-promises', 'saves you time', None),
        ('C8-02', 'benefit-promises', 'eliminates complexity', None),
        ('C8-02', 'benefit-promises', 'just works', None),
        ('C8-02', 'benefit-promises', 'in under 5 minutes', None),
        ('C8-02', 'benefit-promises', 'in minutes', None),
        ('C8-06', 'buzzwords', 'guardrails', None),
        ('C8-06', 'buzzwords', 'agentic', None),
        ('C8-06', 'buzzwords', 'mental model', None),
        ('C8-06', 'buzzwords', 'single source of truth', None),
        ('C8-06', 'buzzwords', 'opinionated', None),
        ('C8-06', 'buzzwords', None, r"\bzero[- ]?downtime\b"),
        ('C8-06', 'buzzwords', None, r"\bre[- ]?platform\b"),
        ('C8-06', 'buzzwords', 'golden path', None),
        ('C8-06', 'buzzwords', 'leverage', None),
        ('C8-06', 'buzzwords', 'onboarding', None),
        ('C8-06', 'buzzwords', 'paradigm', None),
        ('C8-06', 'buzzwords', None, r"\bend[- ]?to[- ]?end\b"),
        ('C3-01', 'casual', 'right away', None),
        ('C3-01', 'casual', 'on its own', None),
        ('C3-01', 'casual', "you'll find", None),
        ('C3-01', 'casual', 'pretty straightforward', None),
        ('C3-01', 'casual', None, r"(?<!\bnot )(?<!\bnever )(?<!n't )(?<!\bnothing but )\bjust\b"),
        ('C3-01', 'casual', None, r"\brais(e|es|ed|ing) the value\b"),
        ('C3-01', 'casual', 'by hand', None),
        ('C3-01', 'casual', None, r"\breach(es|ed|ing)? for\b"),
        ('C3-01', 'casual', None, r"\breach(es|ed|ing)? out\b"),
        ('C3-01', 'casual', None, r"\b(the same|similar|different|these|those|two|all) (kinds?|sorts?) of\b"),
        ('C3-01', 'casual', None, r"\bends? up with\b"),
        ('C3-01', 'casual', None, r"\bfigure out\b"),
        ('C3-01', 'casual', None, r"\bmake sure\b"),
        ('C3-01', 'casual', None, r"\bkeep in mind\b"),
        ('C3-01', 'casual', None, r"\b(two|three|four|several|some|these|those|a few) things\b"),
        ('C3-01', 'casual', None, r"\byou might expect\b"),
        ('C3-01', 'casual', None, r"\b(telling|showing|letting|reminding) you\b"),
        ('C3-01', 'casual', None, r"\bgives? you\b"),
        ('C3-01', 'casual', None, r"\bany time\b(?! (of|in) )"),
        ('C3-01', 'casual', None, r"\bat all\b"),
        ('C3-01', 'casual', None, r"\bkeeps? working\b"),
        ('C3-01', 'casual', None, r"\bswap in\b"),
        ('C3-01', 'casual', None, r"\blook (things|it) up\b"),
        ('C3-01', 'casual', None, r"\bdo something\b"),
        ('C3-01', 'casual', None, r"\bfrom time to time\b"),
        ('C3-01', 'casual', None, r"\bmost often\b"),
        ('C3-01', 'casual', None, r"\bsits? on\b"),
        ('C3-01', 'casual', None, r"\bpulls? in\b"),
        ('C3-01', 'casual', None, r"\bstands? in for\b"),
        ('C3-01', 'casual', None, r"\bfor when you\b"),
        ('C3-01', 'casual', None, r"\btry (loading|running|opening) (them|it) again\b"),
        ('C3-01', 'casual', None, r"\bneeds? nothing else\b"),
        ('C3-01', 'casual', None, r"\bnothing else to (?:run|install|configure|do|set up)\b"),
        ('C3-01', 'casual', None, r"\bthat(?:'s| is) (?:it|all)[.!]"),
        ('C3-01', 'casual', None, r"\byou(?:'re| are) (?:all )?(?:set|done)\b"),
        ('C3-01', 'casual', None, r"\b(?:good|ready) to go\b"),
        ('C3-01', 'casual', None, r"\ba breeze\b"),
        ('C3-01', 'casual', None, r"\bhead(?:s|ed|ing)? over to\b"),
        ('C3-15', 'discourse marker', None, r"^\s*>?\s*(?:\*\*[^*]+\*\*:?\s*)?\**(One caveat|One exception|One catch|One more thing|The catch|The practical consequence|The upshot|The good news|The bad news)\b"),
        ('C3-15', 'discourse marker', None, r"^\s*>?\s*(?:\*\*[^*]+\*\*:?\s*)?\**(Heads up|A word of warning|A word of caution|When in doubt|Worth noting|That said|In short|Long story short|Put simply|Simply put)\b"),
        ('C3-15', 'discourse marker', None, r"^\s*>?\s*(?:\*\*[^*]+\*\*:?\s*)?\**(Wait|Note that|Remember)[.,]"),
        ('C3-15', 'discourse marker', None, r"\beither way\b"),
        ('C3-15', 'discourse marker', None, r"\bworth (knowing|noting|mentioning|being aware of)\b"),
        ('C3-03', 'marketing', 'seamless', None),
        ('C3-03', 'marketing', 'powerful', None),
        ('C3-03', 'marketing', 'instant feedback', None),
        ('C3-03', 'marketing', 'enhanced experience', None),
        ('C8-05', 'out-of-box', 'out of the box', None),
        ('C8-05', 'out-of-box', None, r"\bzero[- ]?config\b"),
        ('C8-05', 'out-of-box', None, r"\bplug[- ]?and[- ]?play\b"),
        ('C3-31', 'page-narration', None, r"\bthis (?:page|document|doc|guide|article|topic|section|tutorial)\s+(?:covers|explains|describes|shows|outlines|details|discusses|introduces|teaches)\b"),
        ('C3-31', 'page-narration', None, r"\bthis (?:page|guide|document|section|tutorial)?\s*walks(?: you)? through\b|\bthis shows you how\b"),
        ('C3-31', 'page-narration', None, r"\bin this (?:page|document|guide|article|topic|tutorial)\b"),
        ('C3-31', 'page-narration', None, r"\byou(?:'ll| will) learn\b"),
        ('C8-08', 'product-defect', 'dead weight', None),
        ('C8-08', 'product-defect', 'reads as a broken product', None),
        ('C8-08', 'product-defect', 'is misleading', None),
        ('C8-08', 'product-defect', 'rather than looking for a toggle', None),
        ('C8-08', 'product-defect', 'technically right and practically misleading', None),
        ('C8-08', 'product-defect', 'no counter and no warning', None),
        ('C8-08', 'product-defect', 'the wizard lies', None),
        ('C8-08', 'product-defect', 'genuinely optional', None),
        ('C8-04', 'readiness-claims', None, r"\bproduction[- ]?ready\b"),
        ('C8-04', 'readiness-claims', None, r"\benterprise[- ]?grade\b"),
        ('C8-04', 'readiness-claims', None, r"\bbattle[- ]?tested\b"),
        ('C8-04', 'readiness-claims', 'proven', None),
        ('C3-32', 'retired-term', None, r"\borg(?:anization)?\s+roles?\b"),
        ('C8-01', 'superlatives', 'robust', None),
        ('C8-01', 'superlatives', 'comprehensive', None),
        ('C8-01', 'superlatives', 'effortless', None),
        ('C8-01', 'superlatives', None, r"\bbest[- ]?in[- ]?class\b"),
        ('C8-01', 'superlatives', None, r"\bworld[- ]?class\b"),
        ('C8-01', 'superlatives', None, r"\bindustry[- ]?leading\b"),
        ('C8-01', 'superlatives', None, r"\bcutting[- ]?edge\b"),
        ('C8-01', 'superlatives', None, r"\bnext[- ]?generation\b"),
        ('C8-03', 'unlock-language', None, r"\bunlock(s|ed|ing)?\b"),
        ('C8-03', 'unlock-language', None, r"\bempower(s|ed|ing)?\b"),
        ('C8-03', 'unlock-language', None, r"\btransform(s|ed|ing)?\b"),
        ('C8-03', 'unlock-language', None, r"\brevolutioniz(e|es|ed|ing)\b"),
        ('C8-03', 'unlock-language', None, r"\bsupercharg(e|es|ed|ing)\b"),
        ('C8-03', 'unlock-language', None, r"\belevat(e|es|ing)\b"),
    ],
    'anthropomorphism': [
        ('C3-18', 'figurative idiom', None, r"\bthe (highest|first|last|lowest) one wins\b"),
        ('C3-18', 'figurative idiom', None, r"\boutlast(s|ed|ing)?\b"),
        ('C3-18', 'figurative idiom', None, r"\bfails? loudly\b"),
        ('C3-18', 'figurative idiom', None, r"\bfails? silently\b"),
        ('C3-18', 'figurative idiom', None, r"\bmeans nothing to\b"),
        ('C3-18', 'figurative idiom', None, r"\bbehaving as intended\b"),
        ('C3-18', 'figurative idiom', None, r"\bdid not help\b"),
        ('C3-18', 'figurative idiom', None, r"\bsaves? (the (app|server|client|runtime)) an?\b"),
        ('C3-18', 'intentional-verb', None, r"\badvertis(e|es|ed|ing)\b"),
        ('C3-18', 'intentional-verb', None, r"\bannounc(e|es|ed|ing)\b"),
        ('C3-18', 'intentional-verb', None, r"(?<!\byou )\bdecides?\b"),
        ('C3-18', 'intentional-verb', None, r"(?<!\byou )(?<!\bmodel )\bchooses?\b"),
        ('C3-18', 'intentional-verb', None, r"\brefuses?\b"),
        ('C3-18', 'intentional-verb', None, r"\bignores?\b"),
        ('C3-18', 'intentional-verb', None, r"(?<!\byou )\bwants?\b"),
        ('C3-18', 'intentional-verb', None, r"(?<!\bmodel )\b(knows|thinks|understands|believes|remembers|learns)\b"),
        ('C3-18', 'intentional-verb', None, r"(?<!\bmodel )\bsees\b"),
        ('C3-18', 'intentional-verb', None, r"\bcares about\b"),
    ],
    'passive-voice': [
        ('C3-10', 'passive voice (absolute and small-clause participle)', None, r"\bwith\s+(?:[A-Za-z][A-Za-z_-]*\s+){1,4}(?:not\s+)?(?!advanced\b|aged\b|based\b|complicated\b|concerned\b|dedicated\b|detailed\b|fixed\b|interested\b|limited\b|located\b|married\b|qualified\b|related\b|supposed\b|unaffected\b|unauthenticated\b|unauthorized\b|undefined\b|uninitialized\b|unlocalized\b|unrelated\b|unsupported\b|unchanged\b|designed\b|intended\b|expected\b|needed\b|required\b|focused\b|prepared\b|used\b)(?:[a-z]+-)?[a-z]{3,}ed\b(?=\s*(?:[,.;:)|]|$))"),
        ('C3-10', 'passive voice (absolute and small-clause participle)', None, r"\b(?:needs?|keep|keeps|leave|leaves|want|wants)\s+(?:the|a|an|its|their|your|one|every|each)\s+(?:[a-z][a-z_-]*\s+){0,3}(?!advanced\b|aged\b|based\b|complicated\b|concerned\b|dedicated\b|detailed\b|fixed\b|interested\b|limited\b|located\b|married\b|qualified\b|related\b|supposed\b|unaffected\b|unauthenticated\b|unauthorized\b|undefined\b|uninitialized\b|unlocalized\b|unrelated\b|unsupported\b|unchanged\b|designed\b|intended\b|expected\b|needed\b|required\b|focused\b|prepared\b|used\b)(?:[a-z]+-)?[a-z]{3,}ed\b(?=\s*(?:[,.;:)|]|$))"),
        ('C3-10', 'passive voice (absolute and small-clause participle)', None, r"\b(?:when|unless|once|until|where|if)\s+(?:not\s+)?(?!advanced\b|aged\b|based\b|complicated\b|concerned\b|dedicated\b|detailed\b|fixed\b|interested\b|limited\b|located\b|married\b|qualified\b|related\b|supposed\b|unaffected\b|unauthenticated\b|unauthorized\b|undefined\b|uninitialized\b|unlocalized\b|unrelated\b|unsupported\b|unchanged\b|designed\b|intended\b|expected\b|needed\b|required\b|focused\b|prepared\b|used\b)(?:[a-z]+-)?[a-z]{3,}ed\b(?=\s*(?:[,.;:)|]|$))"),
        ('C3-10', 'passive voice (explicit by-agent)', None, r"\b(?:is|are|was|were|been|being)\b(?:\s+(?:not|already|still|also|now|currently|[a-z]+ly))?\s+(?!advanced\b|aged\b|based\b|complicated\b|concerned\b|dedicated\b|detailed\b|fixed\b|interested\b|limited\b|located\b|married\b|qualified\b|related\b|supposed\b|unaffected\b|unauthenticated\b|unauthorized\b|undefined\b|uninitialized\b|unlocalized\b|unrelated\b|unsupported\b|unchanged\b|unpublished\b|designed\b|intended\b)[a-z]{3,}ed\s+by\s+(?!default\b|design\b)(?:the\s+|an?\s+|this\s+|that\s+)?[a-z]+\b"),
        ('C3-10', 'passive voice (explicit by-agent)', None, r"\b(?:is|are|was|were|been|being)\b(?:\s+(?:not|already|still|also|now|currently|[a-z]+ly))?\s+(?<!well\s)(?<!widely\s)(?:sent|read|set|given|done|seen|written|taken|made|held|kept|found|put|shown|known|bound|thrown|broken|chosen|driven|left|built|bought|brought|caught|taught|sold|told|understood|spent|dealt|led|cut|hit|let|shut|split|run|drawn|grown|hidden|frozen|stolen|cast|spread)\s+by\s+(?!default\b|design\b)(?:the\s+|an?\s+|this\s+|that\s+)?[a-z]+\b"),
        ('C3-10', 'passive voice (elided auxiliary)', None, r"(?:^|\|)\s*(?:\*\*)?(?:Hosted|Selected|Carried|Grouped|Scoped|Named|Derived|Exposed|Shared|Captured|Listed|Offered|Capped|Sent|Shown|Built|Added|Returned|Stored)\s+(?:at|per|through|by|to|from|in|on|across|as|with|after)\b"),
        ('C3-10', 'passive voice (elided auxiliary)', None, r"\|\s*(?:\*\*)?(?!not\b)[A-Z][A-Za-z-]*(?:\s+[a-z-]+){0,2}\s+(?:not\s+)?(?:found|granted|denied|authorized|blocked|rejected|refused|required|expired|exceeded|supported|activated)\b(?=\s*(?:[|,.]|$|on\b|for\b|in\b|by\b))"),
        ('C3-10', 'passive voice (get-passive)', None, r"\b(?:get|gets|got|getting)\b(?:\s+(?:not|already|still|[a-z]+ly))?\s+(?!rid\b|advanced\b|aged\b|based\b|complicated\b|concerned\b|dedicated\b|detailed\b|fixed\b|interested\b|limited\b|located\b|married\b|qualified\b|related\b|supposed\b|unaffected\b|unauthenticated\b|unauthorized\b|undefined\b|uninitialized\b|unlocalized\b|unrelated\b|unsupported\b|unchanged\b|unpublished\b|designed\b|intended\b)[a-z]{3,}ed\b(?:\s+(?:with|by|to|from|in|on|for))?"),
        ('C3-10', 'passive voice (get-passive)', None, r"\b(?:get|gets|got|getting)\b(?:\s+(?:not|already|still|[a-z]+ly))?\s+(?<!well\s)(?<!widely\s)(?:sent|set|given|done|seen|written|taken|made|held|kept|found|put|shown|known|bound|thrown|broken|chosen|driven|left|built|caught|taught|sold|told|understood|cut|hit|let|shut|split|run|drawn|grown|hidden|frozen|stolen|cast|spread)\b(?:\s+(?:with|by|to|from|in|on|for))?"),
        ('C3-10', 'passive voice (irregular participle)', None, r"\b(?:is|are|was|were|be|been|being)\b(?:\s+(?:not|already|still|also|now|currently|automatically|properly|correctly|typically|usually|generally|often|[a-z]+ly))?\s+(?<!well\s)(?<!widely\s)(?:sent|read|set|given|done|seen|written|taken|made|held|kept|found|put|shown|known|bound|thrown|broken|chosen|driven|left|built|bought|brought|caught|taught|sold|told|understood|spent|dealt|led|cut|hit|let|shut|split|run|drawn|grown|hidden|frozen|stolen|cast|spread)\b(?:\s+(?:with|by|to|from|in|on|for))?"),
        ('C3-10', 'passive voice (modal + be)', None, r"\b(?:can|could|may|might|must|shall|should|will|would)\s+be\b(?:\s+(?:not|already|still|also|now|currently|[a-z]+ly))?\s+(?!advanced\b|aged\b|based\b|complicated\b|concerned\b|dedicated\b|detailed\b|fixed\b|interested\b|limited\b|located\b|married\b|qualified\b|related\b|supposed\b|unaffected\b|unauthenticated\b|unauthorized\b|undefined\b|uninitialized\b|unlocalized\b|unrelated\b|unsupported\b|unchanged\b|unpublished\b|designed\b|intended\b)[a-z]{3,}ed\b(?:\s+(?:with|by|to|from|in|on|for))?"),
        ('C3-10', 'passive voice (modal + be)', None, r"\b(?:can|could|may|might|must|shall|should|will|would)\s+be\b(?:\s+(?:not|already|still|also|now|currently|[a-z]+ly))?\s+(?<!well\s)(?<!widely\s)(?:sent|read|set|given|done|seen|written|taken|made|held|kept|found|put|shown|known|bound|thrown|broken|chosen|driven|left|built|bought|brought|caught|taught|sold|told|understood|spent|dealt|led|cut|hit|let|shut|split|run|drawn|grown|hidden|frozen|stolen|cast|spread)\b(?:\s+(?:with|by|to|from|in|on|for))?"),
        ('C3-10', 'passive voice (progressive)', None, r"\b(?:is|are|was|were|be)\s+being\s+(?:[a-z]+-)?[a-z]{2,}ed\b"),
        ('C3-10', 'passive voice (reduced relative / postnominal participle)', None, r",\s+(?:(?:not|already|newly|each|all|or|and|also)\s+)?(?!advanced\b|aged\b|based\b|complicated\b|concerned\b|dedicated\b|detailed\b|fixed\b|interested\b|limited\b|located\b|married\b|qualified\b|related\b|supposed\b|unaffected\b|unauthenticated\b|unauthorized\b|undefined\b|uninitialized\b|unlocalized\b|unrelated\b|unsupported\b|unchanged\b|designed\b|intended\b|expected\b|needed\b|required\b|focused\b|prepared\b|used\b)(?:[a-z]+-)?[a-z]{3,}ed\s+(?:by|to|from|for|at|in|on|as|with|per|across|through|under|into)\b"),
        ('C3-10', 'passive voice (reduced relative / postnominal participle)', None, r"\b(?:the|a|an|its|their|your|our|one|any|anyone|someone|everyone|every|each|those|these|this|that)\s+(?:[a-z][a-z-]*\s+){0,3}[a-z][a-z-]*\s+(?:(?:not|already|newly)\s+)?(?:grouped|built|exported|offered|capped|listed|scoped|named|derived|installed|attached|captured|expanded|shaped|bounded|configured|exposed|imported|connected|shown|added|made|selected|sent|given|written|held|kept|hidden|split|drawn|bound|thrown|chosen)\s+(?:by|to|from|for|at|in|on|as|with|per|across|through|after|this way)\b"),
        ('C3-10', 'passive voice (reduced relative / postnominal participle)', None, r"\b[a-z]{4,}s\s+(?:(?:not|already|newly)\s+)?(?:grouped|built|exported|offered|capped|listed|scoped|named|derived|installed|attached|captured|expanded|shaped|bounded|configured|exposed|imported|connected|added|selected)\s+(?:by|to|from|for|at|in|on|as|with|per|across|through|this way)\b"),
        ('C3-10', 'passive voice (regular participle)', None, r"\b(?:is|are|was|were|be|been|being)\b(?:\s+(?:not|already|still|also|now|currently|automatically|properly|correctly|typically|usually|generally|often|[a-z]+ly))?\s+(?!advanced\b|aged\b|based\b|complicated\b|concerned\b|dedicated\b|detailed\b|fixed\b|interested\b|limited\b|located\b|married\b|qualified\b|related\b|supposed\b|unaffected\b|unauthenticated\b|unauthorized\b|undefined\b|uninitialized\b|unlocalized\b|unrelated\b|unsupported\b|unchanged\b|unpublished\b|designed\b|intended\b)[a-z]{3,}ed\b(?:\s+(?:with|by|to|from|in|on|for))?"),
    ],
    'over-promise': [
        ('C8-10', 'over-promise', None, r"\bno (?:setup|installation|configuration|app|code)(?: is)? (?:needed|required)\b"),
        ('C8-10', 'over-promise', None, r"\b(?:with|requires?|needs?) no (?:setup|installation|configuration|app|code)\b"),
        ('C8-10', 'over-promise', None, r"\bnothing to (?:install|configure|set up)\b"),
        ('C8-10', 'over-promise', None, r"\b(?:works|compatible) with (?:any|every)\b"),
        ('C8-10', 'over-promise', None, r"\bnever (?:fails|breaks|goes down|loses)\b"),
        ('C8-10', 'over-promise', None, r"\balways (?:works|succeeds|available|up to date|in sync)\b"),
        ('C8-10', 'over-promise', None, r"(?<!\bnot )(?<!\bno )\bguarantee[sd]?\b"),
        ('C8-10', 'over-promise', None, r"\binstantly\b|\bin real[- ]time\b|\bin seconds\b"),
        ('C8-10', 'over-promise', None, r"\bfully automatic(?:ally)?\b"),
        ('C8-10', 'over-promise', None, r"\bzero (?:setup|effort)\b"),
    ],
    'house-verbs': [
        ('C3-21', 'house verb', None, r"\bhold(s|ing)?\b(?!\s+(a|the|this)\s+(lock|role|session|reference))"),
        ('C3-21', 'house verb', None, r"\bcarr(y|ies|ied|ying)\b(?!\s+(a|the|its)\s+signature)"),
        ('C3-21', 'house verb', None, r"(?<!\byou )\bnames?\b(?=\s+(the|a|an|which|what)\b)"),
        ('C3-21', 'house verb', None, r"(?<!\byou )\basks?\s+(for|you)\b"),
        ('C3-21', 'house verb', None, r"(?<!\byou )\boffers?\b"),
        ('C3-21', 'house verb', None, r"\bhides?\b"),
        ('C3-21', 'house verb', None, r"\blets? you\b"),
        ('C3-21', 'house verb', None, r"(?<!\byou )\bpicks?\b"),
    ],
    'periphrasis': [
        ('C3-09', 'periphrasis', None, r"\blong list\b.{0,40}\bpages?\b"),
        ('C3-09', 'periphrasis', None, r"\bpages?\b.{0,40}\blong list\b"),
        ('C3-09', 'periphrasis', 'read in pages', None),
        ('C3-09', 'periphrasis', 'returned in pages', None),
        ('C3-09', 'periphrasis', 'retrieved in pages', None),
        ('C3-09', 'periphrasis', None, r"\bretrieve\b.{0,40}\bin pages\b"),
        ('C3-09', 'periphrasis', None, r"\bpage through\b.{0,25}\b(manually|by hand|yourself)\b"),
    ],
    'metaphors': [
        ('C3-08', 'metaphor', None, r"\bwalks?\b"),
        ('C3-08', 'metaphor', 'grandparent locale', None),
        ('C3-08', 'metaphor', 'ancestor locale', None),
        ('C3-08', 'metaphor', 'parent locale', None),
        ('C3-08', 'metaphor', None, r"\bunwrap(s|ped|ping)?\b"),
        ('C3-08', 'metaphor', 'pass over', None),
    ],
    'vague-reference': [
        ('C3-24', 'vague-reference', None, r"\bthis (url|example|snippet|command|code|shape|format|structure|text|payload|output|message|error|diagram|image|screenshot)\b"),
        ('C3-24', 'vague-reference', None, r"\bthis (table|list|order|sequence|set|series)\b"),
        ('C3-24', 'vague-reference', None, r"\bthese (cases|steps|values|parameters|options|fields|examples|commands|errors|messages|tabs|rows)\b"),
        ('C3-24', 'vague-reference', None, r"\blike th(is|ese)\b"),
        ('C3-24', 'vague-reference', None, r"\bin th(is|at) (order|way|form|shape)\b"),
    ],
    'wordy': [
        ('C3-07', 'wordy', 'in practice', None),
        ('C3-07', 'wordy', 'which means', None),
        ('C3-07', 'wordy', 'due to the fact that', None),
        ('C3-07', 'wordy', 'for the purpose of', None),
        ('C3-07', 'wordy', 'it should be noted that', None),
        ('C3-07', 'wordy', 'rather than letting', None),
        ('C3-07', 'wordy', 'the fact that', None),
        ('C3-07', 'wordy', 'in the event that', None),
        ('C3-07', 'wordy', 'at this point in time', None),
    ],
}
