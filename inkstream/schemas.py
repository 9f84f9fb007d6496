"""Explicit schemas of the library's entities; missing fields read as null."""

from __future__ import annotations

ARTICLE = "id string, title string, url string, source string, published_at timestamp, ingested_at timestamp, snippet string, aiSummary string, discoveredAt timestamp, publishedDateInvalid boolean, usedDiscoveredAtFallback boolean, sourceType string, categoryHint string, _corrupt_record string"
SEARCH_RESULT = "url string, title string, snippet string, domain string, topic string, publishedDate string, score double, _corrupt_record string"
EXTRACTED = "url string, title string, snippet string, domain string, extractedText string, wordCount int, hash string, topic string, publishedDate string, publishedDateInvalid boolean, author string, discoveredAt string, sourceType string, paywallStatus string, paywallReason string, _corrupt_record string"
RANKED = "url string, rank int, why string, primaryTag string, insightType string, controversyRisk string, confidence double"
DIGEST = "weekLabel string, tz string, startISO string, endISO string, builtAt string, topics map<string, struct<total: int, top: array<struct<title: string, url: string, source: string, date: string>>>>, totals struct<total: int, byTopic: map<string, int>>, coverImageUrl string, _corrupt_record string"
RSS_ITEM = "title string, link string, pubDate string, description string"
API_RESULT = "results array<struct<url: string, content: string, raw_content: string>>"
