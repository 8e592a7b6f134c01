"""Business plans: silver conformance, marts, billing, storefront and order book."""
