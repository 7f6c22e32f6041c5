"""Plans: which partitions a batch touches, eligibility, what a physical plan holds."""
