"""Laws of the algebra and the rewrites they justify."""
