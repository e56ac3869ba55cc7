"""Rule packs and their registry."""
