"""Sections that each document type expects, and acronyms."""

# Expected sections in order, with how far each is required.

SECTION_ORDER: dict[str, list[tuple[str, str]]] = {
    'conceptual-guide': [
        ('SEO front matter (title, description, URL)', 'Required'),
        ('Page title', 'Required'),
        ('Overview', 'Required'),
        ('Quick Reference', 'Optional'),
        ('Quick Decision Guide', 'If multiple paths'),
        ('Prerequisites', 'If setup is involved'),
        ('Main Content', 'Required'),
        ('Theory Sections', 'Optional'),
        ('Troubleshooting', 'Recommended'),
        ('Next Steps or See also', 'Required'),
    ],
    'feature-doc': [
        ('SEO front matter (title, description, URL)', 'Required'),
        ('Page title', 'Required'),
        ('Overview', 'Required'),
        ('Quick Decision Guide', 'If multiple approaches'),
        ('Prerequisites', 'If setup is involved'),
        ('Main Content', 'Required'),
        ('Theory Sections', 'Optional'),
        ('Troubleshooting', 'Required'),
        ('Next Steps or See also', 'Required'),
    ],
    'how-to-guide': [
        ('SEO front matter (title, description, URL)', 'Required'),
        ('Page title', 'Required'),
        ('Overview', 'Required'),
        ('Quick Decision Guide', 'Rarely'),
        ('Prerequisites', 'Required'),
        ('Main Content', 'Required'),
        ('Theory Sections', 'Rare'),
        ('Troubleshooting', 'Optional'),
        ('Next Steps or See also', 'Required'),
    ],
    'setup-guide': [
        ('SEO front matter (title, description, URL)', 'Required'),
        ('Page title', 'Required'),
        ('Overview', 'Required'),
        ('Quick Decision Guide', 'If multiple environments'),
        ('Prerequisites', 'Required'),
        ('Main Content', 'Required'),
        ('Theory Sections', 'Rare'),
        ('Troubleshooting', 'Required'),
        ('Next Steps or See also', 'Required'),
    ],
    'kickstarter': [
        ('SEO front matter (title, description, URL)', 'Required'),
        ('Page title', 'Required'),
        ('Overview', 'Required'),
        ('Quick Decision Guide', 'Rarely'),
        ('Prerequisites', 'Required'),
        ('Main Content', 'Required'),
        ('Theory Sections', 'Not used'),
        ('Troubleshooting', 'Optional'),
        ('Next Steps or See also', 'Required'),
    ],
    'migration-guide': [
        ('SEO front matter (title, description, URL, version)', 'Required'),
        ('Page title', 'Required'),
        ('Overview', 'Required'),
        ('Quick Decision Guide', 'If multiple migration paths exist'),
        ('Prerequisites', 'Required'),
        ('Type Mapping Reference', 'Required if the API surface changes'),
        ('Main Content', 'Required'),
        ('Gradual Migration', 'Required if a partial migration path exists'),
        ('Troubleshooting', 'Required'),
        ('Pre-Upgrade Checklist', 'Required'),
        ('Next Steps or See also', 'Required'),
    ],
    'getting-started': [
        ('SEO front matter (title, description, URL)', 'Required'),
        ('Page title', 'Required'),
        ('Overview', 'Required'),
        ('Role-Based Routing Table', 'Required'),
        ('Prerequisites', 'Required'),
        ('Quick Start', 'Required'),
        ('Documentation Map', 'Required'),
        ('Next Steps or See also', 'Required'),
    ],
    'chapter-index': [
        ('SEO front matter (title, description, URL)', 'Required'),
        ('Page title', 'Required'),
        ('Overview', 'Required'),
        ('On this chapter', 'Required'),
        ('Continue', 'Optional'),
        ('See also', 'Required'),
    ],
    'cli-command-reference': [
        ('SEO front matter (title, description, URL)', 'Required'),
        ('Page title', 'Required'),
        ('Overview', 'Required'),
        ('Quick Reference', 'If the doc covers 3 or more commands'),
        ('Prerequisites', 'Required'),
        ('Installation', 'If the plugin is not bundled'),
        ('Commands', 'Required'),
        ('Examples', 'Required'),
        ('Limitations', 'Required'),
        ('Next Steps', 'Recommended'),
    ],
    'cli-task-runbook': [
        ('SEO front matter (title, description, URL)', 'Required'),
        ('Page title', 'Required'),
        ('Overview', 'Required'),
        ('Quick Decision Guide', 'If the operation has more than one path'),
        ('Prerequisites', 'Required'),
        ('Steps for Execution', 'Required'),
        ('Verification', 'Recommended'),
        ('Limitations', 'Required'),
        ('Next Steps', 'Recommended'),
    ],
    'cli-module-reference': [
        ('SEO front matter (title, description, URL)', 'Required'),
        ('Page title', 'Required'),
        ('Overview', 'Required'),
        ('Quick Reference', 'Required'),
        ('Precedence and Scope', 'Recommended'),
        ('Main Content', 'Required'),
        ('Next Steps', 'Recommended'),
    ],
    'cli-plugin-guide': [
        ('SEO front matter (title, description, URL)', 'Required'),
        ('Page title', 'Required'),
        ('Overview', 'Required'),
        ('Prerequisites', 'Required'),
        ('Plugin Structure', 'Required'),
        ('Creating a Plugin', 'Required'),
        ('Plugin Registration and Linking', 'Required'),
        ('Commands and Flags', 'Required'),
        ('Testing', 'Recommended'),
        ('Publishing', 'Required'),
        ('Managing Installed Plugins', 'Recommended'),
        ('Available Methods and Utilities', 'Optional'),
        ('Limitations', 'Recommended'),
        ('Next Steps', 'Required'),
    ],
}

# Acronyms and their expansions.

ACRONYMS: list[tuple[str, str]] = [
    ('CDA', 'Content Delivery API'),
    ('CMA', 'Content Management API'),
    ('HMAC', 'Hash-based Message Authentication Code'),
    ('OAuth', 'Open Authorization'),
    ('SSR', 'server-side rendering'),
    ('SSG', 'static site generation'),
    ('CSR', 'client-side rendering'),
    ('BFF', 'backend for frontend'),
    ('CDN', 'content delivery network'),
    ('CI', 'continuous integration'),
    ('CD', 'continuous delivery'),
    ('SSO', 'single sign-on'),
]

# Path prefixes (first match wins) and the rules a class is exempt from.

CLASS_PREFIXES: list[tuple[str, str]] = [
    ('docs/prompts/', 'agent-prompt'),
    ('prompts/', 'agent-prompt'),
    ('skills/', 'agent-prompt'),
    ('docs/_', 'internal'),
    ('docs/adr/', 'internal'),
    ('docs/assets/', 'internal'),
    ('docs/AGENTS.md', 'internal'),
    ('AGENTS.md', 'internal'),
    ('README.md', 'internal'),
    ('CONTRIBUTING.md', 'internal'),
    ('docs/', 'published'),
]
DEFAULT_CLASS = 'internal'
CLASS_EXEMPT: dict[str, list[str]] = {
    'published': [],
    'agent-prompt': ['FM-01', 'FM-02', 'C1-01', 'C1-02', 'MIG-02', 'C2-04'],
    'internal': ['FM-01', 'FM-02', 'C1-01', 'C1-02', 'MIG-02', 'C2-04'],
}
