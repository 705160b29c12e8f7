"""filmloom: overlay-text and depth-repair analytics over ordered frame streams, on Spark."""
