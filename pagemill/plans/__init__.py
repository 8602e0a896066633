"""Plan shapes that keep hot keys out of single tasks, and the end-to-end plans built on them."""
