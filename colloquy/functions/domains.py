"""Expansion of domain names into search keywords."""

from __future__ import annotations

# Search keywords per domain name.
DOMAIN_KEYWORDS = {
    "ai-dev": "AI machine learning LLM model GPT Claude agent",
    "backend-dev": "backend server API database endpoint REST GraphQL",
    "frontend-dev": "frontend React Next.js CSS HTML UI component",
    "data-engineering": "data pipeline ETL parquet database SQL",
    "devops": "deploy Docker CI CD infrastructure server",
    "database": "database SQL Postgres Supabase query table",
    "python": "Python pip poetry virtualenv package module",
    "web-scraping": "scrape crawl fetch parse HTML extract",
    "automation": "automate script cron schedule pipeline",
    "prompt-engineering": "prompt system instructions context token",
    "documentation": "docs README documentation guide reference",
    "business-strategy": "business strategy revenue pricing market",
    "career": "career job resume interview hiring",
    "finance": "finance budget cost revenue expense",
    "personal": "personal life family health",
    "health": "health sleep exercise medication ADHD",
    "education": "learn study course tutorial",
    "torah": "Torah parsha halacha shiur",
    "cognitive-architecture": "cognitive ADHD monotropic hyperfocus executive function",
    "wotc": "WOTC tax credit employment",
    "mobile-dev": "mobile iOS Android app Swift",
    "ai-strategy": "AI strategy adoption enterprise",
    "ai-image": "image generation diffusion stable Dall-E",
}

MIN_KEYWORD = 3


def keywords_for(domain: str) -> list[str]:
    """The domain name itself, then its keywords of at least three letters in order."""
    text = DOMAIN_KEYWORDS.get(domain, domain.replace("-", " ").replace("_", " "))
    return [domain] + [word for word in text.split() if len(word) >= MIN_KEYWORD]


def keyword_rows(domains: list[str]) -> list[tuple[str, str, int]]:
    """(domain, keyword, rank); rank 0 is the exact name."""
    return [(d, k, rank) for d in domains for rank, k in enumerate(keywords_for(d))]
